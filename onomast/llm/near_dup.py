"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes), its size, a 64-bit key of the set and a
   signature of 128 minima. Documents with equal sets form a class; the classes are the vertices from here on.
2. Forest: ``TREES`` orders of the signature. In each tree a vertex has one hash for each prefix length in ``LADDER``; equal
   prefix hashes are the nodes of the tree. Depth adapts to the region: a node of at most ``REGION`` vertices yields its
   vertices as candidates; the vertices of a larger node descend to the next length, and also meet the node's least vertex.
   Vertices that share even the longest prefix in a node above ``REGION`` are dealt into cells of about that size, and each also
   meets the node's least vertex. This finds most links of large nodes cheaply; step 4 finds all.
3. Candidates whose sizes or one-bit sketches rule out the threshold go (more than five standard deviations below it). Each vertex
   first confirms two of them on the full sets, of its small regions and of the least vertices; then all that are still in different
   components. Deeper regions make only candidates of different components, all of which are confirmed. A task doesn't compare what
   its earlier pairs have connected, and returns a forest.
4. Vertices of a large first node that still holds more than one component are joined on the prefixes of their full sets in an
   order from rare to common shingles, whatever became of them at greater depth. Every pair at the threshold shares a prefix
   shingle, so no cap is left without an exact way. Pairs of different components are confirmed.
5. Components of the confirmed links, carried back to the documents of each class.

Scale: the text is read twice, once for the signatures and once for the sets of candidate vertices. Every exchange deals out
small rows by a hash of a prefix or vertex; counts are combined on the map side; joins on a hot key are against a written table,
so the adaptive skew join splits them. A pair at a similarity of exactly 0.75 is missed with a probability of about 2e-6, that of
sharing no first node; the size of the nodes it shares doesn't matter. What is broadcast has 2^20 counters (8 MB).

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; a text of fewer than five words has one
shingle, its whole word sequence; a null doc_id is never a component's id unless no member has one, and then the id is null;
repeated rows are exact copies; doc_id may have any type that a string can be cast back to. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm import textbuf as tb
from onomast.llm.columns import type_of
from onomast.plans.components import connected_components
from onomast.plans.shared import materialize, release, scratch

SHINGLE = 5
PERCENT = 75
HASHES = 128
TREES = 24
LADDER = (3, 5, 8, 12)
REGION = 24
#: Least number of equal sketch bits (of 128) for a candidate; at a similarity of 0.75 the mean is 112, one deviation 3.7.
SKETCH_BITS = 94
#: Slots that count how common shingles are, by their first bits; they set an order and decide nothing else.
SLOT_BITS = 20

_rng = np.random.default_rng(97)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ORDERS = np.stack([_rng.permutation(HASHES)[: LADDER[-1]] for _ in range(TREES)])
_PLACE = np.array([pow(tb.BASE, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    out = []
    for _, encoded in tb.chunks(texts):
        at, h = tb.words(encoded, tb.NOT_SPACE)
        begins = np.searchsorted(at, np.arange(len(encoded) + 1))
        grams = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
        for i in range(SHINGLE):
            grams += h[i : len(h) - SHINGLE + 1 + i] * _PLACE[i]
        grams = tb.mix(grams)
        for lo, hi in zip(begins[:-1], begins[1:]):
            n = hi - lo
            if n >= SHINGLE:
                out.append(np.unique(grams[lo : hi - SHINGLE + 1]))
            elif n:
                out.append(tb.mix((h[lo:hi] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a set, independent of the minima."""
    return int((np.bitwise_xor.reduce(tb.mix(shingles + _STEP)) ^ np.uint64(len(shingles))).astype(np.int64))


def set_check(shingles: np.ndarray) -> int:
    """A second key of a set, which tells sets of one :func:`set_key` apart."""
    return int(tb.mix(shingles ^ _STEP).sum(dtype=np.uint64).astype(np.int64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima, 16 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        part = shingles[lo : lo + 1024]
        least = np.minimum(least, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(1))
    return (tb.mix(least) >> np.uint64(48)).astype(np.uint16)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = shingle_sets(b["text"].tolist())
        yield pd.DataFrame(
            {
                "doc_id": b["doc_id"],
                "text_hash": b["text_hash"],
                "n": [len(s) for s in sets],
                "vertex": pd.array([set_key(s) if len(s) else None for s in sets], "Int64"),
                "check": [set_check(s) for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets],
            }
        )


def _plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each vertex and tree: the hashes of its prefixes, its size and its sketch."""
    for b in batches:
        if not len(b):
            continue
        sig = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), HASHES).astype(np.uint64)
        bits = np.packbits((sig & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
        for t in range(TREES):
            h, prefix = np.full(len(b), t + 1, np.uint64), {}
            for i in range(LADDER[-1]):
                h = (h + sig[:, _ORDERS[t, i]] + np.uint64(1)) * _STEP
                if i + 1 in LADDER:
                    prefix[f"p{i + 1}"] = tb.mix(h).view(np.int64)
            yield pd.DataFrame(prefix | {"v": b["vertex"], "n": b["n"], "s1": bits[:, 0], "s2": bits[:, 1]})


_TREE_SCHEMA = ", ".join(f"p{d} long" for d in LADDER) + ", v long, n int, s1 long, s2 long"


def _may_link(a: str, b: str) -> Column:
    sizes = 100 * F.least(f"{a}.n", f"{b}.n").cast("long") >= PERCENT * F.greatest(f"{a}.n", f"{b}.n").cast("long")
    differing = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return sizes & (differing <= HASHES - SKETCH_BITS)


def _vertex() -> Column:
    return F.struct("v", "n", "s1", "s2")


def _pairs(left_right: DataFrame) -> DataFrame:
    return left_right.where((F.col("l.v") != F.col("r.v")) & _may_link("l", "r")).select(F.greatest("l.v", "r.v").alias("a"), F.least("l.v", "r.v").alias("b"))


def _within(rows: DataFrame, *key: str) -> DataFrame:
    """Candidates of regions of bounded size: each vertex with the later ones of its region, but for those of its component."""
    known = rows if "home" in rows.columns else rows.withColumn("home", F.col("v"))
    regions = known.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("v", "n", "s1", "s2", "home"))).alias("all")).where(F.size("all") > 1)
    later = F.filter(F.slice("all", F.col("i") + 2, F.size("all")), lambda r: r["home"] != F.col("l.home"))
    return _pairs(regions.select(F.posexplode("all").alias("i", "l"), "all").select("l", F.explode(later).alias("r")))


def _nodes(rows: DataFrame, depth: int) -> DataFrame:
    """Rows whose prefix of this depth is shared, with the node's size ``c`` and its ``least`` vertex."""
    p = f"p{depth}"
    rows = rows.drop("c", "least")
    nodes = materialize(rows.groupBy(p).agg(F.count("*").alias("c"), F.min(_vertex()).alias("least")).where("c > 1"), f"forest-{p}")
    return materialize(rows.join(nodes, p), f"region-{p}")


def _to_least(rows: DataFrame) -> DataFrame:
    return _pairs(rows.select(_vertex().alias("l"), F.col("least").alias("r")))


def _descend(large: DataFrame) -> tuple[list[DataFrame], list[tuple[DataFrame, tuple[str, ...]]]]:
    """Below the first depth: candidates with the least vertex of each node and regions to compare within (rows and key)."""
    stars, regions, rows = [_to_least(large)], [], large
    for d in LADDER[1:]:
        inside = _nodes(rows, d)
        regions.append((inside.where(F.col("c") <= REGION), (f"p{d}",)))
        rows = inside.where(F.col("c") > REGION)
        stars.append(_to_least(rows))
    cells = F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / REGION))
    regions.append((rows.withColumn("cell", cells), (f"p{LADDER[-1]}", "cell")))
    return stars, regions


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a task's pairs that join two of its trees. Pairs of one tree are linked through others and aren't compared."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = v = root[up]
        return v

    for batch in batches:
        out = []
        for a, b, left, right in zip(batch["a"].tolist(), batch["b"].tolist(), batch["left"], batch["right"]):
            if (ra := find(a)) == (rb := find(b)):
                continue
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                root[ra] = rb
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _confirm(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Links by the full sets that connect whatever the pairs at the threshold connect."""
    one = pairs.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("left")), "a")
    two = one.join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("right")), "b")
    return materialize(two.select("a", "b", "left", "right").mapInPandas(_joined, "a long, b long"), name)


def _stars(pairs: DataFrame) -> DataFrame:
    """Of the pairs, those of each vertex with its least partner below it and its greatest above it."""
    return pairs.groupBy("a").agg(F.min("b").alias("b")).union(pairs.groupBy("b").agg(F.max("a").alias("a")).select("a", "b")).distinct()


def _grown(components: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The components of earlier ones and of all pairs at the threshold."""
    known = components.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return connected_components(known.union(_confirm(_apart(pairs, components), sets, "links")), "near", written=True)


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    c = components.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    d = components.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(c, "a", "left").join(d, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _torn(large: DataFrame, components: DataFrame) -> DataFrame:
    """``v`` and ``home`` of the vertices of large first nodes that hold more than one component."""
    home = components.select(F.col("id").alias("v"), F.col("component").alias("home"))
    p = f"p{LADDER[0]}"
    rows = materialize(large.select(p, "v").join(home, "v", "left").select(p, "v", F.coalesce("home", "v").alias("home")), "at-home")
    nodes = materialize(rows.groupBy(p).agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo <> hi").select(p), "torn-nodes")
    return materialize(rows.join(nodes, p).select("v", "home").distinct(), "torn")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _commonness(rows: DataFrame) -> np.ndarray:
    """For each slot, the number of shingles of all sets that fall into it: a bounded estimate of how common a shingle is."""
    part = 1 << 12

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            np.add.at(n, _slot(np.frombuffer(b"".join(b["shingles"]), np.uint64)), 1)
        yield pd.DataFrame({"part": range(len(n) // part), "n": [n[i : i + part].tobytes() for i in range(0, len(n), part)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"][:1], "n": [sum(np.frombuffer(x, np.int64) for x in pdf["n"]).tobytes()]})

    counted = rows.select("shingles").mapInPandas(count, "part int, n binary").groupBy("part").applyInPandas(add, "part int, n binary")
    return np.concatenate([np.frombuffer(r["n"], np.int64) for r in sorted(counted.collect(), key=lambda r: r["part"])])


def _sharing_prefix(torn: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different components that can be at the threshold, by prefixes of the full sets.

    With every set in one order, common shingles last: if the first shared shingle is at place i of n and j of m (from 0), no more
    than min(n - i, m - j) shingles are shared, and a pair at the threshold shares t/(1+t) (n + m) or more. So the first n - ceil(t n) + 1
    places of a set are enough, and of those only the places that leave room for a partner of the other's size. This holds for any
    order; with the common shingles last, what a family shares stands in no such place unless its members are near the threshold.
    """
    rows = materialize(torn.join(sets, "v"), "torn-sets")
    sent = rows.sparkSession.sparkContext.broadcast(_commonness(rows))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = sent.value
        for b in batches:
            cut, place, n = [], [], []
            for raw in b["shingles"]:
                s = np.frombuffer(raw, np.uint64)
                n.append(len(s))
                cut.append(s[np.lexsort((s, common[_slot(s)]))][: n[-1] + (-PERCENT * n[-1]) // 100 + 1])
                place.append(np.arange(len(cut[-1])))
            if n:
                rest = b[["v", "home"]].assign(n=n).loc[b.index.repeat([len(c) for c in cut])]
                yield rest.assign(g=np.concatenate(cut).view(np.int64), place=np.concatenate(place))[["g", "v", "home", "n", "place"]]

    shared = materialize(rows.mapInPandas(prefixes, "g long, v long, home long, n int, place int"), "prefixes")
    # Of two components at a shingle, one at least is not the one with most vertices there: only its vertices are held against all.
    sizes = shared.groupBy("g", "home").agg(F.count("*").alias("k"))
    most = materialize(sizes.groupBy("g").agg(F.max_by("home", F.struct("k", "home")).alias("most"), F.count("*").alias("homes")).where("homes > 1").select("g", "most"), "mixed-shingles")
    mixed = materialize(shared.join(most, "g"), "mixed")
    left = mixed.where("home <> most").select("g", F.struct("v", "home", "n", "place").alias("l"))
    right = mixed.select("g", F.struct("v", "home", "n", "place").alias("r"))
    sizes_fit = 100 * F.least("l.n", "r.n").cast("long") >= PERCENT * F.greatest("l.n", "r.n").cast("long")
    room = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place")).cast("long")
    enough = (100 + PERCENT) * room >= PERCENT * (F.col("l.n") + F.col("r.n")).cast("long")
    met = left.join(right, "g").where((F.col("l.home") != F.col("r.home")) & sizes_fit & enough)
    return materialize(met.select(F.greatest("l.v", "r.v").alias("a"), F.least("l.v", "r.v").alias("b")).distinct(), "prefix-pairs")


def _classes(signed: DataFrame) -> DataFrame:
    """A row for each set: its least doc_id, a document to read it from, its size and signature, and its two keys."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("rep")
    said = signed.where("vertex is not null").groupBy("vertex")
    return materialize(said.agg(F.min("doc_id").alias("least"), rep, F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("check").alias("check"), F.max("check").alias("other"), F.first("key").alias("key")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) and group_key (equal in a group, null for a document
    without shingles) for every document."""
    with scratch() as keep:
        tb.small_batches(docs.sparkSession)
        id_type = type_of(docs, "doc_id")
        slim = docs.select("doc_id", "text")
        sent = slim.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        signed = sent.mapInPandas(_sign, "doc_id string, text_hash long, n int, vertex long, check long, sig binary")
        signed = materialize(signed.withColumns({"doc_id": F.col("doc_id").cast(id_type), "key": F.col("vertex")}), "signatures")
        classes = _classes(signed)
        shared = classes.where("check <> other").select("vertex", F.col("check").alias("first"))
        if not shared.isEmpty():  # sets of one key: all but one get another
            again = signed.join(shared, "vertex", "left").withColumn("vertex", F.when(F.col("check") != F.col("first"), F.xxhash64("vertex", "check")).otherwise(F.col("vertex")))
            again = materialize(again.select(signed.columns), "signatures")
            release(signed, classes)
            signed = again
            classes = _classes(signed)
        trees = classes.select("vertex", "n", "sig").mapInPandas(_plant, _TREE_SCHEMA)
        inside = _nodes(trees, LADDER[0])
        large = inside.where(F.col("c") > REGION)
        stars, regions = _descend(large)
        candidates = materialize(_union([_within(inside.where(F.col("c") <= REGION), f"p{LADDER[0]}"), *stars]).distinct(), "candidates")

        def sets_of(vertices: DataFrame, name: str) -> DataFrame:
            wanted = vertices.distinct().join(classes.select(F.col("vertex").alias("v"), "rep", "key", "check"), "v").select("v", "key", "check", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"))

            def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    sets = shingle_sets(b["text"].tolist())
                    ours = [len(s) > 0 and set_key(s) == k and set_check(s) == c for s, k, c in zip(sets, b["key"], b["check"])]
                    yield pd.DataFrame({"v": b["v"], "shingles": [s.tobytes() for s in sets]})[np.array(ours, bool)]

            # Repeated rows and rows without a doc_id can match more than once; equal texts have equal sets, of which one is kept.
            hashed = slim.withColumn("hash", F.xxhash64("text"))
            read = hashed.join(wanted, hashed["doc_id"].eqNullSafe(wanted["id"]) & (hashed["hash"] == wanted["hash"])).select("v", "key", "check", "text").mapInPandas(cut, "v long, shingles binary")
            return materialize(read.groupBy("v").agg(F.first("shingles").alias("shingles")), name)

        sets = sets_of(candidates.select(F.col("a").alias("v")).union(candidates.select("b")).union(large.select("v")), "sets")
        components = connected_components(_confirm(_stars(candidates), sets, "links"), "near", written=True)
        components = _grown(components, candidates, sets)
        home = components.select(F.col("id").alias("v"), F.col("component").alias("home"))
        at_home = lambda rows: rows.join(home, "v", "left").withColumn("home", F.coalesce("home", "v"))
        deeper = _union([_within(at_home(rows), *key) for rows, key in regions])
        components = _grown(components, deeper.distinct(), sets)
        torn = _torn(large, components)
        if not torn.isEmpty():
            more = _sharing_prefix(torn, sets)
            components = _grown(components, more, sets)
        # A component's id is its least doc_id, so the least of each class is taken over the component's classes.
        joined = classes.select("vertex", "least").join(components.select(F.col("id").alias("vertex"), "component"), "vertex", "left")
        grouped = joined.select("vertex", F.coalesce("component", "vertex").alias("component"), "least")
        named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        of_vertex = materialize(grouped.select("vertex", "component").join(materialize(named, "named"), "component").select("vertex", "component", "component_id"), "of-vertex")
        keep += [signed, of_vertex]
    out = signed.select("doc_id", "text_hash", "n", "vertex").join(of_vertex, "vertex", "left")
    component = F.when(F.col("vertex").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", F.col("component").alias("group_key"))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """The same rows from all pairs of literal shingle sets."""
    def shingles(text: str | None) -> frozenset:
        w = (text or "").encode().lower().split()
        w = [x for x in w if x]
        return frozenset(tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)) if len(w) >= SHINGLE else frozenset([tuple(w)] if w else ())

    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs)]
