"""Grouping of names that mean one sample.

Names are blocked by signature, so different numbers never meet. Within a block, names with equal features are one vertex; candidates
come from an index of one-character deletions instead of pairs of a block; the exact predicate then decides; links are closed
transitively; groups that hold a substituted letter fall back to one group for each skeleton.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions import distance as D
from onomast.functions import names as N
from onomast.plans.components import connected_components
from onomast.plans.shared import materialize, spread

OFFLINE = ("rules", "damerau")
FEATURES = ("signature", "norm", "skeleton", "letters")


def check_arguments(method: str, threshold: float, methods: tuple[str, ...] = OFFLINE) -> None:
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; one of {methods}")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0.0 and 1.0, not {threshold}")


def with_features(names: DataFrame) -> DataFrame:
    """Distinct ``name`` with its features and the number ``vertex`` of its feature set (its own for an empty normal form)."""
    distinct = spread(names.select("name").where("name is not null").distinct(), "name")
    out = distinct.withColumns(N.features(F.col("name")))
    alone = F.when(F.col("norm") == "", F.col("name"))
    return materialize(out.withColumn("vertex", F.xxhash64(*FEATURES, alone)), "features")


def _struct(prefix: str = ""):
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in FEATURES))


def _candidates(vertices: DataFrame) -> DataFrame:
    """Pairs a > b of vertices that could match by a typo: they share a deletion of their letters, or a normal form."""
    block = F.xxhash64("signature")
    letters = F.array_join("letters", "")
    forms = F.array_distinct(F.array(F.col("skeleton"), letters))
    variants = F.array_distinct(F.flatten(F.transform(forms, lambda s: F.concat(F.array(s), N.deletions(s)))))
    rows = vertices.where("norm <> ''").select("vertex", F.explode(F.concat(F.transform(variants, lambda v: F.xxhash64(block, v)), F.array(F.xxhash64(block, F.lit("norm"), "norm")))).alias("key"))
    left, right = rows.select("key", F.col("vertex").alias("a")), rows.select("key", F.col("vertex").alias("b"))
    return left.join(right, "key").where("a > b").select("a", "b").distinct()


def _links(vertices: DataFrame, method: str, threshold: float) -> DataFrame:
    feature = lambda v, f: vertices.select(F.col("vertex").alias(v), _struct().alias(f))
    if method == "rules":
        first = vertices.where("norm <> ''").groupBy("signature", "norm").agg(F.min("vertex").alias("b"))
        pairs = vertices.where("norm <> ''").join(first, ["signature", "norm"]).where(F.col("vertex") != F.col("b")).select(F.col("vertex").alias("a"), "b")
    else:
        pairs = spread(_candidates(vertices), "a", "b")
    joined = pairs.join(feature("a", "fa"), "a").join(feature("b", "fb"), "b")
    same_block = F.col("fa.signature") == F.col("fb.signature")
    return joined.where(same_block & D.matches(F.col("fa"), F.col("fb"), method, threshold)).select("a", "b")


def split_on_substitution(rows: DataFrame, group: str = "component") -> DataFrame:
    """Append ``part``: '' where no two members of the group differ by a substituted letter, else the member's skeleton."""
    skeleton_gap = F.transform(F.sequence(F.lit(1), F.greatest(F.length("skeleton"), F.lit(1))), lambda i: F.concat_ws("\0", F.lit("s"), i, F.substring("skeleton", F.lit(1), i - 1), F.substring("skeleton", i + 1, F.length("skeleton"))))
    by_skeleton = rows.select(group, F.explode(skeleton_gap).alias("gap"), F.col("skeleton").alias("word"), "norm")
    forbidden = by_skeleton.groupBy(group, "gap").agg(F.min("word").alias("w"), F.max("word").alias("x"), F.min("norm").alias("n"), F.max("norm").alias("m"))
    forbidden = forbidden.where("w <> x and (n <> m or n = '')").select(group)
    tokens = rows.where(F.size("letters") >= 2).select(group, F.size("letters").alias("k"), F.posexplode("letters").alias("j", "word"))
    token_gap = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat_ws("\0", i, F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    by_token = tokens.withColumn("gap", F.explode(token_gap)).groupBy(group, "k", "j", "gap").agg(F.min("word").alias("w"), F.max("word").alias("x")).where("w <> x").select(group)
    bad = forbidden.union(by_token).distinct().withColumn("bad", F.lit(True))
    return rows.join(bad, group, "left").withColumn("part", F.when(F.col("bad"), F.col("skeleton")).otherwise(F.lit(""))).drop("bad")


def group_names(names: DataFrame, method: str = "damerau", threshold: float = 0.85) -> DataFrame:
    """``name`` -> ``name, group`` with features; group = the least name of its group."""
    check_arguments(method, threshold)
    featured = with_features(names)
    vertices = materialize(spread(featured.dropDuplicates(["vertex"]).drop("name"), "vertex"), "vertices")
    components = connected_components(_links(vertices, method, threshold), "names")
    rows = featured.join(components.select(F.col("id").alias("vertex"), "component"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    rows = materialize(spread(rows, "name"), "clustered")
    split = split_on_substitution(rows).drop("vertex")
    least = split.groupBy("component", "part").agg(F.min("name").alias("group"))
    return materialize(split.join(least, ["component", "part"]).drop("component", "part"), "groups")


def naive_groups(names: DataFrame, method: str = "damerau", threshold: float = 0.85) -> DataFrame:
    """Links by comparing all pairs of a block: the reference plan for tests."""
    featured = with_features(names)
    left = featured.select("signature", F.col("name").alias("a"), _struct().alias("fa"))
    right = featured.select("signature", F.col("name").alias("b"), _struct().alias("fb"))
    return left.join(right, "signature").where(F.col("a") < F.col("b")).where(D.matches(F.col("fa"), F.col("fb"), method, threshold)).select("a", "b")
