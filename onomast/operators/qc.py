"""The data of the quality panels as tables; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions import distance as D
from onomast.functions import names as N

MAX_NAMES = 40
MAX_FLAGS = 9


def heat_names(groups: DataFrame, limit: int = MAX_NAMES) -> list[str]:
    """Members of the largest groups first, whole groups at a time; one that doesn't fit is skipped, unless it is the first."""
    rows = groups.select("members").orderBy(F.size("members").desc(), F.get("members", F.lit(0)))
    out: list[str] = []
    for r in rows.toLocalIterator():
        if not out or len(out) + len(r["members"]) <= limit:
            out += r["members"]
        if len(out) >= limit:
            break
    return out


def similarity_matrix(groups: DataFrame, limit: int = MAX_NAMES) -> DataFrame:
    """``i, j, left, right, similarity`` for at most ``limit`` names (so at most limit squared rows); 0 where signatures differ."""
    names = heat_names(groups, limit)
    spark = groups.sparkSession
    base = spark.createDataFrame([*enumerate(names)], "i int, name string").withColumns(N.features(F.col("name")))
    feature = F.struct("signature", "norm", "skeleton", "letters")
    left = base.select("i", F.col("name").alias("left"), feature.alias("a"))
    right = base.select(F.col("i").alias("j"), F.col("name").alias("right"), feature.alias("b"))
    pairs = left.join(right, F.col("a.signature") == F.col("b.signature")).withColumn("p", D.comparable(F.col("a"), F.col("b")))
    scores = pairs.select("i", "j", D.similarity(F.col("p.l"), F.col("p.r")).alias("similarity"))
    grid = left.select("i", "left").crossJoin(F.broadcast(right.select("j", "right")))  # limit x limit rows
    return grid.join(scores, ["i", "j"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def colour_floor(matrix: DataFrame) -> float:
    """The 20th percentile, by place, of the panel's cells off the diagonal."""
    values = matrix.where("i <> j").agg(F.array_sort(F.collect_list("similarity")).alias("v")).first()["v"]
    return values[len(values) // 5] if values else 0.0


def group_sizes(groups: DataFrame) -> DataFrame:
    """``id, label, spellings, rows`` of the groups that join spellings."""
    rows = F.aggregate(F.map_values("occurrences"), F.lit(0).cast("long"), lambda a, n: a + n)
    label = F.left(N.shorten(F.col("final")), F.lit(22))
    return groups.where(F.size("members") > 1).select("id", label.alias("label"), F.size("members").alias("spellings"), rows.alias("rows"))


def before_after(groups: DataFrame, near_misses: DataFrame) -> DataFrame:
    """One row: names in the column, samples after grouping, groups that need a merge, pairs to check."""
    counts = groups.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("names"), F.count("*").alias("samples"), F.count_if(F.size("members") > 1).alias("merges"))
    return counts.crossJoin(near_misses.agg(F.count("*").alias("near_misses")))  # two tables of one row


def _described(pairs: DataFrame) -> DataFrame:
    """``name, other`` with the label of their difference."""
    feature = lambda c: F.struct(*(v.alias(k) for k, v in N.features(F.trim(F.col(c)) if c == "name" else F.col(c)).items()))
    return pairs.withColumn("a", feature("name")).withColumn("b", feature("other")).withColumn("difference", D.describe(F.col("a"), F.col("b"), F.trim("name"), F.col("other"))).drop("a", "b")


def flags(groups: DataFrame, near_misses: DataFrame, limit: int = MAX_FLAGS) -> DataFrame:
    """``name, other, difference, merged``: pairs first, then members of merges that differ by more than formatting, of large groups
    first; a report of ``limit`` rows."""
    pairs = _described(near_misses.select(F.col("left").alias("name"), F.col("right").alias("other"), F.lit(0).alias("size")))
    members = groups.where(F.size("members") > 1).select(F.explode("members").alias("name"), F.col("proposed").alias("other"), F.size("members").alias("size"))
    members = _described(members).where(~F.col("difference").isin("identical", "formatting only"))
    ranked = pairs.withColumns({"merged": F.lit("no"), "k": F.col("name"), "l": F.col("other")})
    both = ranked.union(members.withColumns({"merged": F.lit("yes"), "k": F.col("other"), "l": F.col("name")}))
    first = both.orderBy("merged", F.col("size").desc(), "k", "l").limit(limit)
    return first.select(N.shorten(F.col("name")).alias("name"), N.shorten(F.col("other")).alias("other"), "difference", "merged")
