"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item's windows of ``window`` consecutive words are the patterns; an item of fewer words is one pattern of its own
length. For each pattern length a block of two words (one for short patterns) at the end of the current text window is looked
up in a shift table; a positive shift skips positions that no pattern can end at, a zero shift leads to the bucket of the
window's suffix, and its patterns are compared word by word.

Scale: no shuffle. The benchmark streams to the driver, which holds one block of at most ``block_bytes`` of text (and its last item)
at a time and makes its tables one broadcast. ``CHAINED`` blocks are searched in one pass over the documents; for more, the documents
with their hits so far are written and read again, so neither the driver nor a worker holds more tables than that, whatever the
benchmark's size.

Defined cases: a null or empty text (of either table) has no words and is never hit; an item without words has no pattern;
items with the same item_id count once; words of an item without an id are hits, but it is no item of ``n_items``; repeated
documents are judged each; an empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.textbuf import small_batches
from onomast.plans.shared import materialize, release

WINDOW = 13
CHAINED = 8
HITS = "n long, spans array<long>, items array<long>"
#: Maps each byte outside [0-9A-Za-z\x80-\xFF] to a blank and A-Z to a-z.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, as UTF-8."""
    return text.encode().translate(NORMAL).split() if text else []


@dataclass
class WuManber:
    """Patterns of one length m (in words) and the tables over their blocks."""

    m: int
    block: int
    shift: dict = field(default_factory=dict)
    bucket: dict = field(default_factory=lambda: defaultdict(list))

    @classmethod
    def build(cls, m: int, patterns: dict[tuple[bytes, ...], set[int]]) -> WuManber:
        made = cls(m, min(2, m))
        for words, items in patterns.items():
            for end in range(made.block, m + 1):
                key = words[end - made.block : end]
                made.shift[key] = min(made.shift.get(key, m), m - end)
            made.bucket[words[m - made.block :]].append((words, items))
        made.bucket = dict(made.bucket)
        return made

    def search(self, words: list[bytes], covered: list[tuple[int, int]], found: set[int]) -> None:
        """Append the [start, end) word spans of occurrences and add the items whose patterns occur."""
        m, block, shift, bucket = self.m, self.block, self.shift, self.bucket
        longest, end, n = m - block + 1, m, len(words)
        get = shift.get
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = get(key, longest)
            if step:
                end += step
                continue
            window = None
            for pattern, items in bucket[key]:
                if pattern[0] == words[end - m]:
                    window = window or tuple(words[end - m : end])
                    if pattern == window:
                        covered.append((end - m, end))
                        found |= items
            end += 1


def build(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(dict)
    for item, text in items:
        words = split_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1) if m else ():
            by_length[m].setdefault(tuple(words[i : i + m]), set()).update(() if item is None else (int(item),))
    return [WuManber.build(m, patterns) for m, patterns in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark's rows, streamed to the driver a partition at a time, in blocks of bounded text."""
    held, total = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        held.append((r[0], r[1]))
        total += len(r[1] or "") + 16
        if total >= block_bytes:
            yield held
            held, total = [], 0
    if held:
        yield held


def union_length(spans: list[tuple[int, int]]) -> int:
    n, last = 0, 0
    for s, e in sorted(spans):
        if e > last:
            n, last = n + e - max(s, last), e
    return n


def _searcher(tables: Broadcast) -> Callable:
    """A function that adds one block's hits to what earlier blocks have found."""

    @F.pandas_udf(HITS)
    def search(text: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        ns, all_spans, all_items = [], [], []
        for t, s, i in zip(text, spans, items):
            words = split_words(t)
            covered, found = [], set(i)
            for table in tables.value:
                table.search(words, covered, found)
            ns.append(len(words))
            all_spans.append(np.concatenate([np.asarray(s, np.int64), np.asarray(covered, np.int64).ravel()]))
            all_items.append(np.fromiter(found, np.int64, len(found)))
        return pd.DataFrame({"n": ns, "spans": all_spans, "items": all_items})

    return search


def find_hits(docs: DataFrame, benchmark: DataFrame, into: str = "hits", window: int = WINDOW, block_bytes: int = 1 << 20, chained: int = CHAINED) -> DataFrame:
    """All columns of ``docs`` plus ``into``, which ``docs`` may not have: the number of words, the spans that are hit (start, end
    alternating, in words) and the distinct items, unordered."""
    small_batches(docs.sparkSession)
    none = F.array().cast("array<long>")
    out = docs.withColumn(into, F.struct(F.lit(0).cast("long").alias("n"), none.alias("spans"), none.alias("items")))
    written, i = None, 0
    for i, block in enumerate(_blocks(benchmark, block_bytes), 1):
        out = out.withColumn(into, _searcher(docs.sparkSession.sparkContext.broadcast(build(block, window)))("text", F.col(into)["spans"], F.col(into)["items"]))
        if i % chained == 0:
            out = materialize(out, "hits")
            if written is not None:
                release(written)
            written = out
    return out if i else out.withColumn(into, _searcher(docs.sparkSession.sparkContext.broadcast([]))("text", F.col(into)["spans"], F.col(into)["items"]))


@F.pandas_udf(T.LongType())
def _covered(spans: pd.Series) -> pd.Series:
    return pd.Series([union_length([*zip(s[0::2], s[1::2])]) if len(s) else 0 for s in spans], dtype="int64")


def contamination(hits: DataFrame, into: str = "hits") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated in place of the working column of :func:`find_hits`."""
    hit = F.col(into)
    names = F.array_sort(F.transform(hit["items"], lambda i: i.cast("string")))
    out = hits.withColumns({"n_words": hit["n"], "n_hit": _covered(hit["spans"]), "n_items": F.size(hit["items"]).cast("long"), "items_sha256": F.sha2(F.array_join(names, ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop(into)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    slim = docs.select("doc_id", "text")
    return contamination(find_hits(slim, benchmark, window=window)).drop("text")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same rows by trying every pattern at every position."""
    out = []
    windows = []
    for item, text in items:
        w = split_words(text)
        m = min(window, len(w))
        windows += [(item, w[i : i + m]) for i in range(len(w) - m + 1)] if m else []
    for doc, text in docs:
        w = split_words(text)
        hit, found = set(), set()
        for item, p in windows:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found |= set() if item is None else {item}
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
