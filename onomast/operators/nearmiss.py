"""Pairs to show a person: names apart by one digit, and names apart by one letter, found through indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions import chars
from onomast.functions import names as N
from onomast.plans.shared import materialize

MAX_VARIANT_LETTERS = 2


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def as_number(component: Column) -> Column:
    """The value of a decimal component of any script, as a string of ASCII digits without padding; null if it isn't one."""
    foreign = "".join(c for z in chars.zeros() if z != "0" for c in (chr(ord(z) + i) for i in range(10)))
    ascii_ = "0123456789" * (len(foreign) // 10)
    digits = F.translate(component, foreign, ascii_)
    return F.when(component.rlike(r"^\p{Nd}+$"), F.regexp_replace(digits, "^0+(?=[0-9])", ""))


def _neighbours(value: Column) -> Column:
    """The values one below and one above a string of digits, of any length: the last digit that doesn't carry moves, the rest turn."""
    up_tail, down_tail = F.regexp_extract(value, "9*$", 0), F.regexp_extract(value, "0*$", 0)
    up_head, down_head = F.substring(value, F.lit(1), F.length(value) - F.length(up_tail)), F.substring(value, F.lit(1), F.length(value) - F.length(down_tail))
    last = lambda s: F.right(s, F.lit(1))
    start = lambda s: F.substring(s, F.lit(1), F.length(s) - 1)
    up = F.concat(F.when(up_head == "", "1").otherwise(F.concat(start(up_head), F.translate(last(up_head), "012345678", "123456789"))), F.translate(up_tail, "9", "0"))
    down = F.concat(start(down_head), F.translate(last(down_head), "123456789", "012345678"), F.translate(down_tail, "0", "9"))
    down = F.when(down_head == "", F.lit(None).cast("string")).otherwise(F.regexp_replace(down, "^0+(?=[0-9])", ""))
    return F.array(down, up)


def find_near_misses(featured: DataFrame) -> DataFrame:
    """``left, right``: equal skeletons and signatures, but for one component that lost or gained one character; not where both
    numbers have a neighbour in the series that the names use at that place."""
    rows = featured.select("name", "skeleton", F.posexplode("signature").alias("i", "component"), "signature")
    before = F.slice("signature", F.lit(1), F.col("i"))
    after = F.slice("signature", F.col("i") + 2, F.size("signature"))
    rows = rows.select("name", "component", _key(F.col("skeleton"), F.col("i"), before, F.lit("|"), after, F.size("signature")).alias("key"), _key(F.col("skeleton"), F.col("i")).alias("place"))
    rows = materialize(rows, "components-of-names")
    seen = materialize(rows.select("place", as_number(F.col("component")).alias("value")).where("value is not null").distinct(), "series")
    beside = materialize(seen.select("place", F.explode(_neighbours(F.col("value"))).alias("value")).where("value is not null").join(seen, ["place", "value"], "left_semi").distinct(), "in-series")
    longer = rows.select("key", "place", F.col("name").alias("a"), F.col("component").alias("longer"), F.explode(N.deletions(F.col("component"))).alias("shorter"))
    pairs = longer.join(rows.select("key", F.col("name").alias("b"), F.col("component").alias("shorter")), ["key", "shorter"]).where("a <> b")
    pairs = pairs.select("place", "a", "b", as_number(F.col("longer")).alias("x"), as_number(F.col("shorter")).alias("y"))
    mark = lambda column: beside.select("place", F.col("value").alias(column), F.lit(True).alias(f"in_{column}"))
    known = pairs.join(mark("x"), ["place", "x"], "left").join(mark("y"), ["place", "y"], "left")
    suppressed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.coalesce("in_x", F.lit(False)) & F.coalesce("in_y", F.lit(False))
    return known.where(~suppressed).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()


def find_letter_variants(featured: DataFrame) -> DataFrame:
    """``left, right``: equal signatures and skeletons but for one letter, at a place that no more than two letters occupy."""
    at = F.explode(F.sequence(F.lit(1), F.length("skeleton")))
    rows = featured.where("skeleton <> ''").select("name", "signature", "skeleton", at.alias("i"))
    key = _key(F.col("signature"), F.size("signature"), F.col("i"), F.substring("skeleton", F.lit(1), F.col("i") - 1), F.lit("|"), F.substring("skeleton", F.col("i") + 1, F.length("skeleton")))
    rows = materialize(rows.select("name", key.alias("key"), F.substring("skeleton", F.col("i"), F.lit(1)).alias("letter")), "letters-of-names")
    two = materialize(rows.groupBy("key").agg(F.min("letter").alias("x"), F.max("letter").alias("y"), F.count_distinct("letter").alias("n")).where(f"n = {MAX_VARIANT_LETTERS}"), "two-letters")
    sided = rows.join(two, "key")
    left = sided.where("letter = x").select("key", F.col("name").alias("a"))
    right = sided.where("letter = y").select("key", F.col("name").alias("b"))
    return left.join(right, "key").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()


def reported_pairs(featured: DataFrame) -> DataFrame:
    return find_near_misses(featured).union(find_letter_variants(featured)).distinct()
