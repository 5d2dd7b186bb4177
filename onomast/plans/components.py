"""Connected components by alternating large-star and small-star rounds.

Every step is a groupBy (combined on the map side) and an equi-join against a written table, so a vertex with very many neighbours
is dealt out by the adaptive skew join. Nothing is collected to the driver. A round begins with the least neighbour of each vertex, and
the same rows tell whether the edges are stars already, so the last round costs one table. Tables go when the next step is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.plans.shared import materialize, release


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """``a, m, open``: the least vertex of each neighbourhood; open where it is neither the centre nor a leaf of a star."""
    smaller = F.when(F.col("b") < F.col("a"), F.col("b"))
    each = _neighbours(edges).groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.max(smaller).alias("below"))
    is_open = (F.col("lo") < F.col("a")) & ((F.col("hi") > F.col("a")) | (F.col("lo") != F.col("below")))
    return each.select("a", F.least("a", "lo").alias("m"), is_open.alias("open"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _neighbours(edges).where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 64, written: bool = False) -> DataFrame:
    """``(a, b)`` links -> ``(id, component)`` for each vertex of a link, component = its least reachable vertex.

    Self links and nulls are ignored, repeated links are one; a vertex without a link has no row. An empty table gives an empty table.
    ``written``: the links are cheap to read again, so they are not written once more."""
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    current = current if written else materialize(current, name)
    own = [] if written else [current]
    for _ in range(max_rounds):
        least = materialize(_least(current), f"{name}-least")
        if least.where("open").isEmpty():
            release(*own)
            return least.select(F.col("a").alias("id"), F.col("m").alias("component"))
        large = materialize(_large_star(current, least.drop("open")), f"{name}-large")
        release(least, *own)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        current = materialize(_small_star(large, least), f"{name}-small")
        release(large, least)
        own = [current]
    raise RuntimeError("components did not settle")
