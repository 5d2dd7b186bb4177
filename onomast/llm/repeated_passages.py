"""Removal of repeated passages: every byte covered by a 400-byte string that starts anywhere else as well.

1. Anchors. Of any 101 consecutive 300-byte strings, those with the least hash are anchors; so each 400-byte string holds an
   anchor, and equal strings hold equal anchors at equal places. Only anchors are exchanged (two in about a hundred bytes): a hash
   of the anchor, two independent hashes of its surroundings (up to 100 bytes on both sides, all that any 400-byte string around it
   can reach): a polynomial of the bytes, and a sum over mixed 8-byte windows.
2. Anchors that occur once are dropped. Occurrences whose surroundings occur twice are repeated as a whole. What is left are
   the few occurrences at the ends of passages, where surroundings differ.
3. Those are compared exactly. A batch of anchor groups is sorted twice, by what follows and by what precedes the anchor, with
   a mergesort whose comparisons are hash-based: prefix polynomial hashes give the longest common extension of two suffixes by
   binary search, so a comparison is logarithmic in its length. Common extensions of neighbours are verified on the bytes, and so
   is the anchor itself; a hash collision falls back to sorting bytes. Two occurrences share the 400-byte string that starts d
   bytes before the anchor if their common extensions are d or more to the left and 100 - d or more to the right, which is read
   off the two sorted orders for all d.
4. Spans are joined to the texts and cut out.

Scale: hashes of anchors are counted on the map side, joins on a hot anchor are against written tables. Ends of passages of one
anchor shared by more than ``GROUP`` different surroundings would be one large sort in one task; they are counted by the two hashes of
their single 400-byte strings instead, rows that combine on the map side. Both ways find the same spans (a test runs both). The whole
text is exchanged once, and once more the texts that hold ends of passages.

Defined cases: a null or empty text has no bytes, no removal and the hash of nothing; texts below 400 bytes lose nothing; repeated
rows are copies of each other and lose all bytes if they have 400; a null doc_id is a value like another. An empty table gives an
empty result. Extra columns are ignored; doc_id may have any type that a string can be cast back to. What is equal is decided on bytes
at the ends of passages, and by 128 bits or more of hashes elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm import textbuf as tb
from onomast.llm.columns import type_of
from onomast.plans.shared import materialize, scratch

LENGTH = 400
ANCHOR = 300
REACH = LENGTH - ANCHOR
GROUP = 4096


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of ``width``, by doubling."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, two hashes with surroundings) of the anchors of a text of 400 bytes or more."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b) - ANCHOR + 1
    prefix = tb.prefix_hashes(b)
    at = np.arange(n)
    h = tb.span_hashes(prefix, at, at + ANCHOR)
    width = REACH + 1
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    p = np.flatnonzero(h == _sliding(np.concatenate([edge, least, edge]), width, np.maximum))
    left, right = np.minimum(p, REACH), np.minimum(n - 1 - p, REACH)
    around = tb.span_hashes(prefix, p - left, p + ANCHOR + right)
    check = tb.span_hashes(tb.check_prefix(b), p - left, p + ANCHOR + right - 7, tb.CHECK_INVERSE)
    return p, h[p], tb.mix(around + (left * 128 + right).astype(np.uint64)), check


ANCHORS = "h long, x long, y long, key long, pos int"


def _emit_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    for b in batches:
        held, total = [], 0
        for key, text in zip(b["key"], b["text"]):
            p, h, x, y = anchors(text.encode())
            held.append((h.view(np.int64), x.view(np.int64), y.view(np.int64), np.full(len(p), key, np.int64), p.astype(np.int32)))
            total += len(p)
            if total > 100_000:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))
                held, total = [], 0
        if held:
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))


def merge_spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of [start, end), as rows (start, end)."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return np.stack([start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]], 1)


def cut_out(raw: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, runs, hash of what is left)."""
    digest, at = hashlib.sha256(), 0
    for s, e in spans.tolist():
        digest.update(raw[at:s])
        at = e
    digest.update(raw[at:])
    return int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()


_SETTLE = "doc_id string, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, open boolean, text string, spans array<long>, ends array<struct<h:long,pos:int,left:int,around:binary>>"


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans known from whole surroundings; texts with ends of passages stay open and lend the bytes around them."""
    for b in batches:
        out = []
        for doc, key, text, pos, kind, h in zip(b["doc_id"], b["key"], b["text"], b["pos"], b["kind"], b["h"]):
            raw, spans, ends, opened = text.encode(), np.zeros((0, 2), np.int64), [], False
            if pos is not None:
                p, k = np.asarray(pos, np.int64), np.asarray(kind, np.int64)
                lo, hi = np.maximum(p - REACH, 0), np.minimum(p + ANCHOR + REACH, len(raw))
                sure = (k & 1) == 0
                spans = merge_spans(lo[sure], hi[sure])
                ends = [{"h": int(h[i]), "pos": int(p[i]), "left": int(p[i] - lo[i]), "around": raw[lo[i] : hi[i]]} for i in np.flatnonzero(k)]
                opened = bool((~sure).any())
            removed, runs, digest = (None, None, None) if opened else cut_out(raw, spans)
            out.append((doc, key, len(raw), removed, runs, digest, opened, text if opened else None, spans.ravel() if opened else None, ends or None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SETTLE.split(", ")]).astype({"n_removed": "Int64", "n_spans": "Int64"})


class Suffixes:
    """Byte strings in one buffer, each compared only with strings of its own group; extensions by hash and binary search."""

    def __init__(self, strings: list[bytes], group: np.ndarray) -> None:
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        self.prefix, self.group = tb.prefix_hashes(self.raw), group
        self.inverse = tb.powers(len(self.raw) + 1, tb.INVERSE)
        self.steps = int(self.length.max(initial=0)).bit_length()

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of the strings a and b, by binary search over equal prefix hashes."""
        sa, sb = self.start[a], self.start[b]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        for _ in range(self.steps):
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[sa + mid] - self.prefix[sa]) * self.inverse[sa] == (self.prefix[sb + mid] - self.prefix[sb]) * self.inverse[sb]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a before b: by group, then bytes, then number, so that the order is total."""
        n = self.extension(a, b)
        end_a, end_b = n == self.length[a], n == self.length[b]
        ca = np.where(end_a, -1, self.raw[self.start[a] + np.where(end_a, 0, n)].astype(np.int16))
        cb = np.where(end_b, -1, self.raw[self.start[b] + np.where(end_b, 0, n)].astype(np.int16))
        ga, gb = self.group[a], self.group[b]
        return np.where(ga != gb, ga < gb, np.where(ca != cb, ca < cb, a < b))

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort; all merges of a level run together, each element finding its rank in the sibling run."""
        order, n, width = np.arange(len(self.length)), len(self.length), 1
        while width < n:
            i = np.arange(n)
            run = i // width
            begin = np.minimum((run ^ 1) * width, n)
            lo, hi = begin.copy(), np.minimum(begin + width, n)
            first = lo
            for _ in range(width.bit_length()):
                mid = np.minimum((lo + hi) >> 1, n - 1)
                go = lo < hi
                before = self.less(order[mid], order[i])
                lo, hi = np.where(go & before, mid + 1, lo), np.where(go & ~before, mid, hi)
            place = np.minimum(run & ~1, run) * width + (i - run * width) + (lo - first)
            merged = np.empty(n, np.int64)
            merged[place] = order
            order, width = merged, width * 2
        return order

    def sorted_with_extensions(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common extension with the one before, -1 at the start of a group), verified on the bytes."""
        order = self.sort()
        a, b = order[:-1], order[1:]
        found = self.extension(a, b)
        m = np.repeat(np.arange(len(a)), found)
        step = np.arange(len(m)) - np.repeat(np.cumsum(found) - found, found)
        if (self.raw[self.start[a][m] + step] != self.raw[self.start[b][m] + step]).any():  # a collision: sort the bytes
            text = [bytes(self.raw[s : s + n]) for s, n in zip(self.start, self.length)]
            order = np.array(sorted(range(len(text)), key=lambda i: (self.group[i], text[i], i)), np.int64)
            a, b = order[:-1], order[1:]
            found = np.array([next((k for k, (x, y) in enumerate(zip(text[i], text[j])) if x != y), min(len(text[i]), len(text[j]))) for i, j in zip(a, b)], np.int64)
        return order, np.concatenate([[-1], np.where(self.group[a] == self.group[b], found, -1)])


def shared_offsets(around: list[bytes], left: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the least and greatest d for which the 400-byte string starting d bytes before its anchor occurs
    again in its group; (1, 0) if none does."""
    middle = [a[n : n + ANCHOR] for a, n in zip(around, left)]
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault((g, m), len(names)) for g, m in zip(group.tolist(), middle)], np.int64)
    n = len(around)
    after, gap_after = Suffixes([a[k + ANCHOR :] for a, k in zip(around, left)], group).sorted_with_extensions()
    before, gap_before = Suffixes([a[:k][::-1] for a, k in zip(around, left)], group).sorted_with_extensions()
    least, most = np.full(n, REACH + 1), np.full(n, -1)
    right_block, left_block = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(REACH + 1):
        right_block[after] = np.cumsum(gap_after < REACH - d)
        left_block[before] = np.cumsum(gap_before < d)
        both = right_block * (n + 1) + left_block
        _, back, count = np.unique(both, return_inverse=True, return_counts=True)
        shared = count[back] > 1
        least[shared] = np.minimum(least[shared], d)
        most[shared] = d
    return np.where(most < 0, 1, least), np.where(most < 0, 0, most)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of the ends of passages, from rows sorted by anchor; groups are never cut."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        least, most = shared_offsets(rows["around"].tolist(), rows["left"].to_numpy(), rows["h"].to_numpy())
        hit = least <= most
        pos = rows["pos"].to_numpy()[hit].astype(np.int64)
        return pd.DataFrame({"key": rows["key"].to_numpy()[hit], "start": pos - most[hit], "end": pos - least[hit] + LENGTH})

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if sum(map(len, held)) < GROUP:
            continue
        rows = pd.concat(held, ignore_index=True)
        whole = rows["h"] != rows["h"].iloc[-1]
        held = [rows[~whole]]
        if whole.any():
            yield work(rows[whole])
    if held:
        yield work(pd.concat(held, ignore_index=True))


def _single_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each 400-byte string around an end of a passage, with its two hashes."""
    for b in batches:
        for key, pos, left, around in zip(b["key"], b["pos"], b["left"], b["around"]):
            raw = np.frombuffer(around, np.uint8)
            at = np.arange(max(len(around) - LENGTH + 1, 0))
            s = tb.span_hashes(tb.prefix_hashes(raw), at, at + LENGTH)
            t = tb.span_hashes(tb.check_prefix(raw), at, at + LENGTH - 7, tb.CHECK_INVERSE)
            yield pd.DataFrame({"s": s.view(np.int64), "t": t.view(np.int64), "key": key, "start": at + pos - left})


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, text, spans, start, end in zip(b["doc_id"], b["text"], b["spans"], b["start"], b["end"]):
            known = np.asarray(spans, np.int64).reshape(-1, 2)
            s, e = (np.zeros(0, np.int64),) * 2 if start is None else (np.asarray(start, np.int64), np.asarray(end, np.int64))
            raw = text.encode()
            out.append((doc, len(raw), *cut_out(raw, merge_spans(np.concatenate([known[:, 0], s]), np.concatenate([known[:, 1], e])))))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    tb.small_batches(docs.sparkSession)
    with scratch() as keep:
        settled, late = _settled(docs, keep)
    done = settled.where("not open").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.union(late).withColumn("doc_id", F.col("doc_id").cast(type_of(docs, "doc_id")))


def _settled(docs: DataFrame, keep: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of texts judged by whole surroundings (and the open rest), rows of that rest; doc_id as a string."""
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    found = keyed.where(F.octet_length("text") >= LENGTH).select("key", "text").mapInPandas(_emit_anchors, ANCHORS)
    # A text of 400 bytes in all has one string; its surroundings are whole, so the rules below hold for it as well.
    whole = F.struct("x", "y")
    again = found.groupBy("h").agg(F.count("*").alias("n"), F.min(whole).alias("a"), F.max(whole).alias("b")).where("n > 1")
    again = materialize(again.select("h", (F.col("a") == F.col("b")).alias("same")), "anchors")
    repeated = materialize(found.join(again, "h").select("h", "x", "y", "key", "pos", "same"), "repeated")
    mixed = repeated.where("not same")
    classes = materialize(mixed.groupBy("h", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("first")), "surroundings")
    partly = materialize(classes.groupBy("h").agg(F.max(F.col("n") == 1).alias("ends")), "partly")
    classes = materialize(classes.join(partly, "h"), "surroundings-known")
    one = F.col("n") == 1
    lends = F.col("ends") & (F.col("first") == F.struct("key", "pos"))
    kinds = mixed.join(classes, ["h", "x", "y"]).select("key", "pos", F.when(one, 3).when(lends, 2).otherwise(0).alias("kind"), "h")
    marks = repeated.where("same").select("key", "pos", F.lit(0).alias("kind"), "h").union(kinds)
    # kind: bit 0, not known to be repeated; bit 1, its bytes are compared.
    by_text = marks.groupBy("key").agg(F.collect_set(F.struct("pos", "kind", "h")).alias("m")).select("key", F.col("m.pos").alias("pos"), F.col("m.kind").alias("kind"), F.col("m.h").alias("h"))
    by_text = materialize(by_text, "marks")
    settled = materialize(keyed.join(by_text, "key", "left").select("doc_id", "key", "text", "pos", "kind", "h").mapInPandas(_settle, _SETTLE), "settled")
    ends = settled.where("ends is not null").select("key", F.explode("ends").alias("e")).select("key", "e.h", "e.pos", "e.left", "e.around")
    sizes = materialize(ends.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "end-groups")
    sized = ends.join(sizes, "h")
    spans = sized.where(F.col("n") <= GROUP).drop("n").repartition("h").sortWithinPartitions("h").mapInPandas(_compare, "key long, start long, end long")
    if not sizes.where(F.col("n") > GROUP).isEmpty():
        single = materialize(sized.where(F.col("n") > GROUP).drop("n").mapInPandas(_single_strings, "s long, t long, key long, start long"), "single-strings")
        # Several anchors can stand in one string, so it is its place that must differ.
        place = F.struct("key", "start")
        twice = materialize(single.groupBy("s", "t").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("s", "t"), "twice")
        spans = spans.union(single.join(twice, ["s", "t"]).select("key", "start", (F.col("start") + LENGTH).alias("end")))
    of_text = materialize(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("m")).select("key", F.col("m.start").alias("start"), F.col("m.end").alias("end")), "end-spans")
    late = settled.where("open").select("key", "doc_id", "text", "spans").join(of_text, "key", "left").select("doc_id", "text", "spans", "start", "end").mapInPandas(_finish, RESULT)
    keep += [settled, of_text]
    return settled, late


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same rows from a table of all strings."""
    seen: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for d, raw in raws:
        at = np.array([i for i in range(len(raw) - length + 1) if seen[raw[i : i + length]] > 1], np.int64)
        out.append((d, len(raw), *cut_out(raw, merge_spans(at, at + length))))
    return out
