"""Toxicity scores from a factorization machine over hashed terms.

``score = sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2))`` over the distinct hashed terms of a text: beside
a weight for each term, the inner product of two terms' factors scores the pair, so an insult next to a group mention can
weigh more than the two words do apart.

Fit: on at most ``max_train_rows`` labelled rows (those with the smallest hashes of doc_id), on the driver; only term ids of
these rows and their labels travel. How strongly a term must be associated with the label to get parameters is chosen from ``CUTS`` on
a fold inside these rows (a fifth of them, by hash), which the fit for the choice doesn't see; the rows held out of training play no
part. Scoring reads every whole text, map-only, with a parameter table of fixed size.

Defined cases: a null or empty text has no terms and gets the score of the intercept; rows with a null label, or labels
without a document, teach nothing; repeated labels of one doc_id count once, the largest; repeated documents are scored each, and
of them one text teaches; without any usable labelled row every score is 0. A null doc_id is not held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import textbuf as tb
from onomast.plans.shared import materialize, release

BITS = 18
#: Chi-squared values with one degree of freedom at the usual levels of 0.05, 0.01 and 0.001.
CUTS = (3.84, 6.63, 10.83)


def term_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hashed term) of each text's distinct terms, by text."""
    rows, ids = [], []
    for first, encoded in tb.chunks(texts):
        at, h = tb.words(encoded, tb.LETTERS)
        both = np.unique((at.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
        rows.append((both >> np.uint64(BITS)).astype(np.int64) + first)
        ids.append((both & np.uint64((1 << BITS) - 1)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(ids)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class FactorizationMachine:
    """Parameters by slot; ``slot[term]`` is -1 for a term without any. At most ``max_terms`` slots."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        s = self.slot[term]
        row, s = row[s >= 0], s[s >= 0]
        out = self.w0 + np.bincount(row, self.w[s], n)
        for f in range(self.v.shape[1]):
            x = self.v[s, f]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def scores(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(row, term, n), -30, 30)))


def associated(row: np.ndarray, term: np.ndarray, label: np.ndarray, rows: np.ndarray, max_terms: int = 4096, min_df: int = 4, cut: float = CUTS[-1]) -> np.ndarray:
    """The terms in ``min_df`` of the marked rows or more whose chi squared with the label is above ``cut``: the ``max_terms`` strongest.
    Counted a piece at a time, so that no copy of all places is made."""
    size, n = 1 << BITS, int(rows.sum())
    df, pos, at_1 = np.zeros(size), np.zeros(size), rows & (label > 0)
    for lo in range(0, len(term), 1 << 19):
        r, t = row[lo : lo + (1 << 19)], term[lo : lo + (1 << 19)]
        df += np.bincount(t[rows[r]], minlength=size)
        pos += np.bincount(t[at_1[r]], minlength=size)
    rate_1 = at_1.sum() / max(n, 1)
    with np.errstate(all="ignore"):
        chi = np.where(df >= min_df, (pos - df * rate_1) ** 2 / np.maximum(df * rate_1 * (1 - rate_1) * (1 - df / max(n, 1)), 1e-9), 0)
    kept = np.argsort(-chi, kind="stable")[:max_terms]
    return np.sort(kept[chi[kept] > cut])


def _summed(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The rows of ``x`` added up by ``at``."""
    return np.stack([np.bincount(at, c, n) for c in x.T], 1).astype(float)  # of no rows, bincount makes integers


def fit(row: np.ndarray, term: np.ndarray, label: np.ndarray, factors: int = 8, max_terms: int = 4096, min_df: int = 4, epochs: int = 12, rate: float = 0.1, l2: float = 2e-4, seed: int = 7, cut: float = CUTS[-1]) -> FactorizationMachine:
    """Adagrad on the logistic loss. Terms kept: those in ``min_df`` texts or more with the strongest association (chi
    squared above ``cut``) with the label; the rest get no parameters, so the many neutral words of a long text add no noise."""
    n, rate_1 = len(label), label.mean() if len(label) else 0.0
    kept = associated(row, term, label, np.ones(n, bool), max_terms, min_df, cut)
    slot = np.full(1 << BITS, -1, np.int64)
    slot[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), factors))
    w0 = float(np.log((rate_1 + 1e-6) / (1 - rate_1 + 1e-6)))
    gw, gv, g0 = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    used = np.isin(term, kept)
    row, s = row[used], slot[term[used]]
    begins = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs if len(kept) else 0):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            batch = order[lo : lo + 256]
            take = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in batch])
            at, ss = np.repeat(np.arange(len(batch)), begins[batch + 1] - begins[batch]), s[take]
            vs = v[ss]
            sums, squares = _summed(at, vs, len(batch)), _summed(at, vs * vs, len(batch))
            m = w0 + np.bincount(at, w[ss], len(batch)) + 0.5 * (sums**2 - squares).sum(1)
            e = 1.0 / (1.0 + np.exp(-np.clip(m, -30, 30))) - label[batch]
            touched, back = np.unique(ss, return_inverse=True)
            dw = np.bincount(back, e[at], len(touched)) + l2 * len(batch) * w[touched]
            dv = _summed(back, e[at, None] * (sums[at] - vs), len(touched))
            dv += l2 * len(batch) * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            g0 += e.sum() ** 2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.5 * rate * dv / np.sqrt(gv[touched])
            w0 -= 0.5 * rate * e.sum() / np.sqrt(g0)
    return FactorizationMachine(slot, w0, w, v)


def choose_cut(row: np.ndarray, term: np.ndarray, label: np.ndarray, inner: np.ndarray) -> float:
    """Of ``CUTS`` the one whose fit on the other rows has the least logistic loss on those of ``inner``."""
    if len(np.unique(label[~inner])) < 2 or not inner.any():
        return CUTS[-1]
    number, tested = np.cumsum(~inner) - 1, np.cumsum(inner) - 1
    # The least cut keeps what any of them keeps; the few places of these terms are all that is copied.
    used = np.isin(term, associated(row, term, label, ~inner, cut=CUTS[0]))
    row, term = row[used], term[used]
    learn, truth, losses = ~inner[row], label[inner], []
    for cut in CUTS:
        model = fit(number[row[learn]], term[learn], label[~inner], epochs=6, cut=cut)
        p = np.clip(model.scores(tested[row[~learn]], term[~learn], int(inner.sum())), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p)))
    return CUTS[int(np.argmin(losses))]


def held_out(column: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5, is 0: the fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> FactorizationMachine | None:
    """Fit on a sample of labelled documents outside the held-out fold; None without any."""
    tb.small_batches(spark)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("__label"))
    place = F.xxhash64(F.lit(3), "doc_id")
    n = usable.count()
    few = usable.where(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * max_train_rows / max(n, 1))) + 1)  # so that the sort has few
    sample = materialize(few.orderBy(F.pmod(place, F.lit(1 << 30)), "doc_id").limit(max_train_rows), "labelled")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, term = term_ids(b["text"].tolist())
            cut = np.searchsorted(row, np.arange(len(b) + 1))
            yield pd.DataFrame({"place": b["place"], "label": b["__label"], "terms": [term[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(b))]})

    # The sample has at most max_train_rows rows of 12 bytes. Of a repeated doc_id one text is taken, so as many rows come back.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(place.alias("place"), "__label", "text").mapInPandas(features, "place long, label int, terms binary")
    got = rows.groupBy("place").agg(F.max("label").alias("label"), F.min("terms").alias("terms")).toPandas().sort_values("place")
    release(sample)
    if got.empty or got["label"].nunique() < 2:
        return None
    label, inner = got["label"].to_numpy(float), got["place"].to_numpy() % 5 == 0
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(t) // 4 for t in got["terms"]])
    term = np.frombuffer(b"".join(got["terms"]), np.int32)
    del got
    return fit(row, term, label, cut=choose_cut(row, term, label, inner))


def score_of(spark: SparkSession, model: FactorizationMachine | None) -> Callable[[str], Column]:
    """A function from the name of a text column to its score."""
    if model is None:
        return lambda text: F.lit(0.0)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(*term_ids(texts.tolist()), len(texts)))

    return scores


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(spark, docs, labels, max_train_rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_of(spark, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
