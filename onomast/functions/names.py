"""Scalar functions over identifier names, as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from onomast.functions import chars

DELIMITER = r"(?U)[_.\s\x1c-\x1f]"
_DIGITS = r"\p{Nd}"
_WORDLIKE = r"[\p{L}\p{Nl}\p{No}]"


def lit_array(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def prepare(name: Column) -> Column:
    """Lower case, one spelling for each sign, and ``_`` for a hyphen between two alphanumerics."""
    folded = F.translate(F.lower(name), *chars.fold_table())
    return F.regexp_replace(folded, r"(?<=[\p{L}\p{N}])-(?=[\p{L}\p{N}])", "_")


def tokens(name: Column) -> Column:
    return F.filter(F.split(prepare(name), DELIMITER, -1), lambda t: t != "")


@functools.cache
def _zero_pattern() -> str:
    return f"^[{chars.zeros()}]+(?={_DIGITS})"


def without_padding(digits: Column) -> Column:
    """Without leading zeros of any script, keeping one digit."""
    return F.regexp_replace(digits, _zero_pattern(), "")


def expand_token(t: Column) -> Column:
    """The canonical term of an abbreviation with its number unpadded; numbers and word-number tokens unpadded; else as it is."""
    number = without_padding(F.regexp_extract(t, f"{_DIGITS}+", 0))
    out = None
    for canonical, aliases, numbered in chars.ABBREVIATIONS:
        pattern = "|".join(chars.alias_pattern(a, numbered) for a in aliases)
        hit, value = t.rlike(f"^(?:{pattern})$"), F.concat(F.lit(canonical), number)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    shape = f"^({_WORDLIKE}+)({_DIGITS}+)({_WORDLIKE}*)$"
    out = out.when(t.rlike(f"^{_DIGITS}+$"), without_padding(t))
    parts = F.concat(F.regexp_extract(t, shape, 1), without_padding(F.regexp_extract(t, shape, 2)), F.regexp_extract(t, shape, 3))
    return out.when(t.rlike(shape), parts).otherwise(t)


def normalise(name: Column) -> Column:
    """The canonical form by rule alone; may be empty."""
    joined = F.regexp_replace(F.array_join(tokens(name), "_"), rf"(?<=[^\p{{Nd}}_])_(?={_DIGITS}+(?:_|$))", "")
    expanded = F.filter(F.transform(F.split(joined, "_", -1), expand_token), lambda t: t != "")
    return F.regexp_replace(F.array_join(expanded, "_"), rf"[^\p{{L}}\p{{N}}_{chars.SIGNS}]", "")


def skeleton(name: Column) -> Column:
    """The lower-case letters of the name."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}]", "")


def signature(name: Column) -> Column:
    """The identity of a name: its numbers in order with their letter suffixes, then its signs with the word they touch."""
    p = prepare(name)
    numbers = F.transform(F.regexp_extract_all(p, F.lit(rf"{_DIGITS}++(?:\p{{L}}++(?!{_DIGITS}))?"), F.lit(0)), without_padding)
    pieces = F.regexp_extract_all(p, F.lit(rf"{_DIGITS}++|\p{{L}}*+[{chars.SIGNS}\p{{Nl}}\p{{No}}\p{{M}}]"), F.lit(0))
    is_number = lambda x: x.rlike(f"^{_DIGITS}")

    def entry(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(pieces, F.lit(1), i), is_number)).cast("string")
        letters = F.regexp_replace(x, r"[^\p{L}]", "")
        sign = F.regexp_replace(x, r"^\p{L}+", "")
        return F.when(~is_number(x), F.concat(before, expand_token(letters), sign))

    signs = F.when(F.exists(pieces, lambda x: ~is_number(x)), F.filter(F.transform(pieces, entry), lambda x: x.isNotNull())).otherwise(lit_array())
    return F.concat(numbers, signs)


def letter_tokens(name: Column) -> Column:
    return F.filter(F.transform(tokens(name), lambda t: F.regexp_replace(t, r"[^\p{L}]", "")), lambda t: t != "")


def deletions(value: Column) -> Column:
    """The distinct strings with one character removed."""
    cut = lambda i: F.concat(F.substring(value, F.lit(1), i - 1), F.substring(value, i + 1, F.length(value)))
    return F.when(F.length(value) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), cut))).otherwise(lit_array())


def is_canonical(name: Column) -> Column:
    """Only lower-case ASCII letters, digits and underscores, and something beside underscores."""
    return name.rlike(r"^[a-z0-9_]+$") & name.rlike(r"[^_]")


def shorten(label: Column, width: int = 26) -> Column:
    """A label of more than ``width`` characters keeps as many at both ends, around an ellipsis."""
    side = F.lit((width - 1) // 2)
    return F.when(F.length(label) <= width, label).otherwise(F.concat(F.left(label, side), F.lit("…"), F.right(label, side)))


def features(name: Column) -> dict[str, Column]:
    """All that grouping reads of a name."""
    return {"signature": signature(name), "norm": normalise(name), "skeleton": skeleton(name), "letters": letter_tokens(name)}
