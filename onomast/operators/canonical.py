"""Canonical names of groups, and groups as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions import distance as D
from onomast.functions import names as N
from onomast.plans.numbering import number_rows
from onomast.plans.shared import materialize, spread


def skeleton_corpus(counts: DataFrame) -> DataFrame:
    """``name, occurrences`` -> ``skeleton, weight``: rows of each skeleton, a name counting once at least."""
    return counts.groupBy(N.skeleton(F.col("name")).alias("skeleton")).agg(F.sum(F.greatest("occurrences", F.lit(1))).alias("weight"))


def elect(grouped: DataFrame, counts: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``group, proposed``: the weighted medoid of the normal forms of each group.

    Least total distance to the group's forms, then agreement with the corpus, then weight, then length, then the text."""
    rows = grouped.select("name", "group", F.when(F.col("norm") != "", F.col("norm")).otherwise(F.col("name")).alias("form")).join(counts, "name", "left")
    forms = rows.groupBy("group", "form").agg(F.sum(F.greatest(F.coalesce("occurrences", F.lit(1)), F.lit(1))).alias("weight"))
    forms = materialize(forms, "forms")
    by_group = forms.groupBy("group").agg(F.count("*").alias("n"), F.min("form").alias("proposed"))
    one = by_group.where("n = 1").select("group", "proposed")
    many = materialize(forms.join(by_group.where("n > 1").select("group"), "group"), "forms-to-choose-from")
    other = many.select("group", F.col("form").alias("other"), F.col("weight").alias("other_weight"))
    costs = spread(many.join(other, "group").where("form <> other"), "form", "other").withColumn("cost", F.col("other_weight") * D.osa()(F.col("form"), F.col("other")))
    costs = costs.groupBy("group", "form", "weight").agg(F.sum("cost").alias("cost")).withColumn("skeleton", N.skeleton(F.col("form")))
    if corpus is not None:
        costs = costs.join(corpus.withColumnRenamed("weight", "agreement"), "skeleton", "left")
    else:
        costs = costs.withColumn("agreement", F.lit(0).cast("long"))
    order = F.struct("cost", (-F.coalesce("agreement", F.lit(0))).alias("a"), (-F.col("weight")).alias("w"), (-F.length("form")).alias("l"), "form")
    return one.union(costs.groupBy("group").agg(F.min_by("form", order).alias("proposed")))


def min_similarity(grouped: DataFrame) -> DataFrame:
    """``group, min_similarity``: the least similarity of two members' skeletons, 4 places half-even; null for one member."""
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("skeleton").alias("k"))
    forms = grouped.select("group", "skeleton").distinct()
    left, right = forms.withColumnRenamed("skeleton", "l"), forms.withColumnRenamed("skeleton", "r")
    scores = spread(left.join(right, "group").where("l < r"), "l", "r").withColumn("s", D.similarity(F.col("l"), F.col("r")))
    least = scores.groupBy("group").agg(F.min("s").alias("s"))
    value = F.when(F.col("n") >= 2, F.bround(F.coalesce("s", F.lit(1.0)), 4))
    return sizes.join(least, "group", "left").select("group", value.alias("min_similarity"))


def group_table(grouped: DataFrame, counts: DataFrame, proposed: DataFrame, method: str) -> DataFrame:
    """One row a group: id, members, proposed, final, status, occurrences, method, min_similarity; ids from 1 by first member."""
    rows = grouped.select("name", "group").join(counts, "name", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    members = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("name", "occurrences"))).alias("m"))
    out = members.join(proposed, "group").join(min_similarity(grouped), "group")
    numbered = number_rows(out, ["group"], "id")
    return numbered.select(
        F.col("id").cast("int").alias("id"), F.col("m.name").alias("members"), "proposed", F.col("proposed").alias("final"), F.lit("proposed").alias("status"),
        F.map_from_entries("m").alias("occurrences"), F.lit(method).alias("method"), "min_similarity",
    )
