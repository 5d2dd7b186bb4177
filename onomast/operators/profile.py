"""Counts of names and the checks that say whether they are written in one way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions import chars
from onomast.functions import names as N

#: White space of any script, and the four separators that Unicode counts as control characters.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def not_blank(name: Column) -> Column:
    return name.rlike(NOT_BLANK)


def name_counts(table: DataFrame, column: str) -> DataFrame:
    """``name, occurrences`` of the values that are neither null nor blank."""
    name = F.col(column).cast("string")
    return table.select(name.alias("name")).where(not_blank(F.col("name"))).groupBy("name").agg(F.count("*").alias("occurrences"))


def detect_abbreviations(names: DataFrame) -> list[str]:
    """Labels of the abbreviations that occur as tokens, in table order; at most one row reaches the driver."""
    table = [(chars.alias_label(c, a, n), chars.alias_pattern(a, n)) for c, aliases, n in chars.ABBREVIATIONS for a in aliases]
    t = names.select(F.explode(N.tokens(F.col("name"))).alias("t"))
    found = t.agg(*(F.coalesce(F.bool_or(F.col("t").rlike(f"^(?:{p})$")), F.lit(False)).alias(f"a{i}") for i, (_, p) in enumerate(table))).first()
    return [label for i, (label, _) in enumerate(table) if found[i]]


def profile(names: DataFrame) -> DataFrame:
    """One row: delimiter_mix, abbreviations_detected, zero_padding, case_mix, verdict."""
    name = F.col("name")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = names.agg(
        *(any_(F.contains(name, F.lit(d))).alias(f"d{i}") for i, d in enumerate("_-.")),
        any_(name.rlike(r"\p{Lu}|\p{IsUppercase}")).alias("upper"),
        any_(name.rlike(r"\p{Ll}|\p{IsLowercase}")).alias("lower"),
    )
    numbers = names.select(F.explode(F.regexp_extract_all(name, F.lit(r"\p{Nd}+"), F.lit(0))).alias("n"))
    padded = F.col("n").rlike(r"^0.")
    seen = numbers.groupBy(F.when(padded, F.regexp_replace("n", "^0+(?=.)", "")).otherwise(F.col("n")).alias("value")).agg(F.bool_or(padded).alias("p"), F.bool_or(~padded).alias("u"))
    both = seen.agg(F.coalesce(F.bool_or(F.col("p") & F.col("u")), F.lit(False)).alias("zero_padding"))
    labels = F.array(*(F.lit(x) for x in detect_abbreviations(names))).cast("array<string>")
    out = flags.crossJoin(both).select(  # two tables of one row
        ((F.col("d0").cast("int") + F.col("d1").cast("int") + F.col("d2").cast("int")) > 1).alias("delimiter_mix"),
        labels.alias("abbreviations_detected"), "zero_padding", (F.col("upper") & F.col("lower")).alias("case_mix"),
    )
    wrong = F.col("delimiter_mix") | (F.size("abbreviations_detected") > 0) | F.col("zero_padding") | F.col("case_mix")
    return out.withColumn("verdict", F.when(wrong, "inconsistencies_found").otherwise("appears_consistent"))
