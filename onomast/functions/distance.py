"""Distances and difference labels. Bounded forms are expressions; the full alignment distance is an Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("damerau", "levenshtein", "hamming")
MIN_SLIP_LENGTH = 5
INDEL, SWAP, SUBSTITUTION, UNRELATED = "insertion or deletion", "transposition", "substitution", "unrelated"


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; null for different lengths."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    differing = F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(F.length(a) == F.length(b), differing)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _osa(a: str, b: str) -> int:
    return int(osa_of([a], [b])[0])


def osa_of(left: list[str], right: list[str], together: int = 1 << 20) -> np.ndarray:
    """Optimal string alignment distances of pairs. Pairs of similar length fill their grids together, a row at a time; a row's
    dependence on its own cells, that of insertions, is a running minimum along the row."""
    out = np.zeros(len(left), np.int64)
    lengths = np.array([(len(a), len(b)) for a, b in zip(left, right)], np.int64).reshape(-1, 2)
    order = np.lexsort((lengths[:, 0], lengths[:, 1]))
    lo = 0
    while lo < len(order):
        hi = lo + max(1, together // (int(lengths[order[lo], 1]) + 1))
        at = order[lo : min(hi, lo + int(np.searchsorted(lengths[order[lo:], 1], 2 * lengths[order[lo], 1] + 8)) + 1)]
        lo += len(at)
        out[at] = _grids([left[i] for i in at], [right[i] for i in at], lengths[at])
    return out


def _code_points(strings: list[str], width: int) -> np.ndarray:
    return np.array(strings, f"<U{max(width, 1)}").view(np.uint32).reshape(len(strings), -1)


def _grids(left: list[str], right: list[str], lengths: np.ndarray) -> np.ndarray:
    x, y = _code_points(left, int(lengths[:, 0].max())), _code_points(right, int(lengths[:, 1].max()))
    each, step = np.arange(len(left)), np.arange(y.shape[1] + 1)
    two, one = None, np.tile(step, (len(left), 1))
    out = lengths[:, 1].copy()  # for an empty left side
    for i in range(1, int(lengths[:, 0].max()) + 1):
        row = np.full_like(one, i)
        row[:, 1:] = np.minimum(one[:, 1:] + 1, one[:, :-1] + (y != x[:, i - 1 : i]))
        if two is not None and y.shape[1] > 1:
            crossed = (y[:, 1:] == x[:, i - 2 : i - 1]) & (y[:, :-1] == x[:, i - 1 : i])
            row[:, 2:] = np.where(crossed, np.minimum(row[:, 2:], two[:, :-2] + 1), row[:, 2:])
        row = np.minimum.accumulate(row - step, axis=1) + step
        ended = each[lengths[:, 0] == i]
        out[ended] = row[ended, lengths[ended, 1]]
        two, one = one, row
    return out


def osa() -> object:
    """Column function: full optimal string alignment distance of two strings."""

    @F.pandas_udf(T.LongType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = pd.Series(pd.NA, range(len(a)), dtype="Int64")
        out[known] = osa_of(a[known].tolist(), b[known].tolist())
        return out

    return distance


def _swapped(a: Column, b: Column) -> Column:
    """One swap of two adjacent characters leads from a to b."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    piece = lambda s, i: F.substring(s, i, F.lit(1))

    def here(i: Column) -> Column:
        crossed = (piece(a, i) == piece(b, i + 1)) & (piece(a, i + 1) == piece(b, i))
        outside = (F.substring(a, F.lit(1), i - 1) == F.substring(b, F.lit(1), i - 1)) & (F.substring(a, i + 2, F.length(a)) == F.substring(b, i + 2, F.length(b)))
        return crossed & outside

    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b) & F.exists(at, here)


def classify(a: Column, b: Column) -> Column:
    """The kind of a single edit between two runs of letters."""
    near = F.levenshtein(a, b, 2)  # -1 above 2
    kind = F.when(a == b, UNRELATED).when(near == 1, F.when(F.length(a) != F.length(b), INDEL).otherwise(SUBSTITUTION))
    return kind.when((near == 2) & _swapped(a, b), SWAP).otherwise(UNRELATED)


def within_one(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of at most 1."""
    return (a == b) | (classify(a, b) != UNRELATED)


def similarity(a: Column, b: Column, method: str = "damerau", distance: Column | None = None) -> Column:
    """1 - distance / longer length; equal strings 1; Hamming of different lengths 0."""
    if method not in METHODS:
        raise ValueError(f"unknown distance method {method!r}; one of {METHODS}")
    if distance is None:
        distance = {"hamming": hamming, "levenshtein": levenshtein}[method](a, b) if method != "damerau" else osa()(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(1 - distance / longest, F.lit(0.0)))


def gained_token(left: Column, right: Column) -> Column:
    """Of two token lists of different lengths, the shorter is a subsequence of the longer."""
    def inside(short: Column, long: Column) -> Column:
        return F.aggregate(long, F.lit(0), lambda at, t: F.when((at < F.size(short)) & F.get(short, at).eqNullSafe(t), at + 1).otherwise(at)) == F.size(short)

    return F.when(F.size(left) == F.size(right), F.lit(False)).when(F.size(left) < F.size(right), inside(left, right)).otherwise(inside(right, left))


def comparable(a: Column, b: Column) -> Column:
    """struct(l, r): the one pair of letter tokens that differs, or else the skeletons."""
    differing = F.filter(F.arrays_zip(a["letters"].alias("l"), b["letters"].alias("r")), lambda p: p["l"] != p["r"])
    single = (F.size(a["letters"]) == F.size(b["letters"])) & (F.size(differing) == 1)
    return F.when(single, F.struct(F.get(differing, 0)["l"].alias("l"), F.get(differing, 0)["r"].alias("r"))).otherwise(F.struct(a["skeleton"].alias("l"), b["skeleton"].alias("r")))


def token_substituted(a: Column, b: Column) -> Column:
    """Two names with as many letter tokens (two or more), one aligned pair of which differs by a substitution."""
    pairs = F.arrays_zip(a["letters"].alias("l"), b["letters"].alias("r"))
    return (F.size(a["letters"]) == F.size(b["letters"])) & (F.size(a["letters"]) >= 2) & F.exists(pairs, lambda p: classify(p["l"], p["r"]) == SUBSTITUTION)


def describe(a: Column, b: Column, left: Column, right: Column) -> Column:
    """The label of a difference; a, b are feature structs, left, right the names."""
    out = F.when(left == right, "identical").when(a["signature"] != b["signature"], "different identifiers")
    out = out.when((a["norm"] != "") & (a["norm"] == b["norm"]), "formatting only").when(a["skeleton"] == b["skeleton"], "formatting only")
    return out.otherwise(classify(a["skeleton"], b["skeleton"]))


def matches(a: Column, b: Column, method: str, threshold: float) -> Column:
    """Whether two names join, decided in the order in which the rules exclude each other; names of different signatures never do."""
    pair = comparable(a, b)
    left, right = pair["l"], pair["r"]
    out = F.when(a["signature"] != b["signature"], False).when(gained_token(a["letters"], b["letters"]), False).when((a["norm"] != "") & (a["norm"] == b["norm"]), True)
    if method == "rules":
        return out.otherwise(False)
    out = out.when((left == "") | (right == ""), False)
    affix = F.startswith(left, right) | F.startswith(right, left) | F.endswith(left, right) | F.endswith(right, left)
    out = out.when((left != right) & affix, False)
    kind = classify(left, right)
    shortest, longest = F.least(F.length(left), F.length(right)), F.greatest(F.length(left), F.length(right))
    out = out.when((left != right) & kind.isin(UNRELATED, SUBSTITUTION), False)
    out = out.when((left != right) & (shortest >= MIN_SLIP_LENGTH), True)
    score = F.when(left == right, F.lit(1.0)).otherwise(1 - 1 / longest)  # the distance is 0 or 1 here
    return out.otherwise(score >= threshold)
