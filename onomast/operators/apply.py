"""A reviewed mapping applied to a table: a lookup that adds a column, keeps every row and changes no other column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_lookup(table: DataFrame, column: str, lookup: DataFrame, canonical_column: str | None = None) -> DataFrame:
    """``table`` plus the canonical name of each row; a name without a decision is its own.

    The join strategy is left to the planner, which broadcasts the lookup only below its size threshold."""
    target = canonical_column or f"{column}_canonical"
    if target == column:
        raise ValueError("the canonical column and the source column are the same")
    if target in table.columns:
        raise ValueError(f"the table already holds a column named {target!r}")
    names = lookup.select(F.col("original").alias("__original"), F.col("canonical").alias("__canonical"))
    joined = table.join(names, F.col(f"`{column}`") == F.col("__original"), "left")
    return joined.withColumn(target, F.coalesce("__canonical", F.col(f"`{column}`"))).drop("__original", "__canonical")


def change_log(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """``original, canonical, changed, occurrences, group`` of every name of the mapping."""
    joined = lookup.join(counts.withColumnRenamed("name", "original"), "original", "left")
    return joined.select("original", "canonical", (F.col("original") != F.col("canonical")).alias("changed"), F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"), "group")


def joined_without_decision(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Names of the data that no group holds and that a changed name of the mapping produces."""
    produced = lookup.where("original <> canonical").select(F.col("canonical").alias("name")).distinct()
    undecided = counts.select("name").join(lookup.select(F.col("original").alias("name")), "name", "left_anti")
    return undecided.join(produced, "name", "left_semi")


def overlap(counts: DataFrame, lookup: DataFrame) -> int:
    return counts.join(lookup.select(F.col("original").alias("name")), "name", "left_semi").count()


def change_summary(applied: DataFrame, column: str, canonical_column: str, changes: DataFrame) -> DataFrame:
    """One row: total_rows, unique_names, rows_changed, names_in_the_mapping, names_changed, names_unchanged."""
    source, target = F.col(f"`{column}`"), F.col(f"`{canonical_column}`")
    rows = applied.agg(F.count("*").alias("total_rows"), F.count_distinct(source).alias("unique_names"), F.coalesce(F.sum((source != target).cast("long")), F.lit(0)).alias("rows_changed"))
    names = changes.agg(F.count("*").alias("names_in_the_mapping"), F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0)).alias("names_changed"))
    return rows.crossJoin(names).withColumn("names_unchanged", F.col("names_in_the_mapping") - F.col("names_changed"))  # two tables of one row
