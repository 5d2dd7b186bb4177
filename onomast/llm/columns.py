"""Working columns beside columns of any name, and ids of any type through Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` and so on that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def type_of(df: DataFrame, column: str) -> T.DataType:
    """The type of a column. An id goes through pandas as a string and is cast back to it: beside a null, pandas would round a long."""
    return df.select(column).schema[0].dataType
