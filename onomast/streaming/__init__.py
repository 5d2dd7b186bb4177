"""A reviewed mapping on a stream: the lookup is a static table, so each micro-batch is one stream-static left join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from onomast.operators.apply import apply_lookup


def apply_stream(stream: DataFrame, column: str, lookup: DataFrame, canonical_column: str | None = None) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream; use apply_lookup")
    return apply_lookup(stream, column, lookup, canonical_column)
