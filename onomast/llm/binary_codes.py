"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables, reranked on the original vectors.

1. Vectors with equal components form a class; one of each class goes on. Null, zero and non-finite vectors are left out.
2. Iterative quantisation on a bounded sample (``SAMPLE`` vectors, those with the smallest hashes): centre, rotate at random, then
   alternate signs and the rotation that best maps the data onto them. Several starts give as many rotations as bits are needed.
3. Every vector gets a binary code; consecutive pieces of the code are the keys of the Hamming tables. Piece length follows the
   number of vectors (about ``BUCKET`` vectors a bucket), the number of tables follows from it, so that a pair at the threshold
   shares a piece with probability 0.9999 or more. How often its bits agree is taken from the sample, about the mean that the codes
   are centred on: vectors with a common mean have wider angles there and get more tables.
4. A bucket's vectors are compared in blocks of bounded size: by the Hamming distance of ``CODE`` bits of their codes, up to a radius
   that a pair at the threshold exceeds with a probability of ``MISS`` or less; what is within it is reranked by exact cosine of the
   original vectors in double precision. A pair is counted in the first table that brings it together, so nothing is counted twice
   and no list of pairs is shuffled: a block returns counts and the edges of a spanning forest.

Scale: a bucket above ``BLOCK`` vectors is cut into cells; each pair of cells is a task of its own, so memory is bounded whatever
the bucket. The rotations (64 x 64 doubles each) are the only broadcast.

Defined cases: equal vectors link with each other whatever their number (by counts, not by pairs); vectors that are null, zero,
hold null or non-finite components, or are empty link with nothing; vectors of different lengths never link; a null vec_id is
counted as a link and is never a component's id unless no member has another. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.plans.components import connected_components
from onomast.plans.shared import materialize, scratch

COSINE = 0.95
SAMPLE = 4096
BUCKET = 1024
BLOCK = 1024
CODE = 128
MISS = 1e-4


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: a rotation R for which sign(xR) is closest to xR."""
    rng = np.random.default_rng(seed)
    r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


def agreement(sample: np.ndarray, mean: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector of the sample, how often a bit of its centred code agrees with that of a vector at the threshold.

    The distance between the two stays, the radius about the mean doesn't: the smaller it is, the wider the centred angle."""
    r = np.maximum(((sample - mean) ** 2).sum(1), 1e-12)
    return np.maximum(0.5, 1 - np.arccos(np.clip(1 - (1 - cosine) / r, -1, 1)) / math.pi)


def plan_tables(n: int, cosine: float, agree: np.ndarray | None = None) -> tuple[int, int]:
    """(bits of a piece, number of tables) for n vectors; the mean miss over ``agree`` is at most ``MISS``. Shorter pieces are taken
    where they cost less: a table costs one move of a vector and its comparisons."""
    agree = np.array([1 - math.acos(cosine) / math.pi]) if agree is None else agree

    def tables(bits: int) -> int:
        miss = lambda t: np.mean((1 - agree**bits) ** t)
        hi = 1
        while miss(hi) > MISS:
            hi *= 2
        lo = hi // 2
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if miss(mid) > MISS else (lo, mid)
        return hi

    most = max(3, math.ceil(math.log2(max(n, 2) / BUCKET)))
    return min(((b, tables(b)) for b in range(3, most + 1)), key=lambda p: p[1] * (1 + n / 2 ** p[0] / BUCKET))


def hamming_radius(agree: np.ndarray, bits: int = CODE, miss: float = MISS) -> int:
    """The least distance that a code of independent bits exceeds, over ``agree``, with a mean probability of at most ``miss``."""
    k = np.arange(bits + 1)
    ways = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in k])
    p = np.clip(1 - agree, 1e-12, 1 - 1e-12)[:, None]
    beyond = 1 - np.cumsum(np.exp(ways + k * np.log(p) + (bits - k) * np.log1p(-p)), 1)
    return int(np.argmax(beyond.mean(0) <= miss))


def _unit(raw: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x


def _encode(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id, unit (bytes of the unit vector, null if it can't link), key (hash of the components)."""

    @F.pandas_udf("binary")
    def unit(v: pd.Series) -> pd.Series:
        out = []
        for a in v:
            x = None if a is None else np.asarray([math.nan if c is None else c for c in a] if a.dtype == object else a, np.float64)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                out.append(None)
            else:
                x = x / np.abs(x).max()
                out.append((x / np.sqrt(x @ x)).tobytes())
        return pd.Series(out, dtype=object)

    return vectors.select(F.col(id_column).alias("vec_id"), unit(F.col(column).cast("array<double>")).alias("unit"))


def _find(cosine: float, radius: int):
    """Links inside a block of one table's bucket: counts by vertex and the edges of a spanning forest."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x, table, left, right = _unit(pdf["unit"]), int(pdf["t"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        cell, vertex, weight = pdf["cell"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy()
        codes = np.stack([np.frombuffer(c, np.int64) for c in pdf["pieces"]])
        bits = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(len(pdf), -1)
        a, b = np.flatnonzero(cell == left), np.flatnonzero(cell == right)
        differing = np.zeros((len(a), len(b)), np.uint8)  # of CODE bits, which is less than 256
        for word in bits.T:
            differing += np.bitwise_count(word[a][:, None] ^ word[b][None, :])
        near = differing <= radius
        if left == right:
            near = np.triu(near, 1)
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(rows, columns)] & (x[a[rows]] @ x[b[columns]].T >= cosine)
        p, q = np.nonzero(near)
        p, q = a[rows[p]], b[columns[q]]
        if table and len(p):
            first = np.zeros(len(p), bool)
            for t in range(table):
                first |= codes[p, t] == codes[q, t]
            p, q = p[~first], q[~first]
        n = np.bincount(p, weight[q], len(pdf)) + np.bincount(q, weight[p], len(pdf))
        root = np.arange(len(pdf))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for k, m in zip(p.tolist(), q.tolist()):
            r, s = find(k), find(m)
            if r != s:
                root[max(r, s)] = min(r, s)
        linked = np.unique(np.concatenate([p, q]))
        return pd.DataFrame({"v": vertex[linked], "n": n[linked].astype(np.int64), "root": vertex[[find(k) for k in linked]]})

    return block


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    with scratch() as keep:
        encoded = materialize(_encode(vectors, id_column, column).withColumn("v", F.xxhash64("unit")), "units")
        usable = encoded.where("unit is not null")
        # A class is keyed by a 64-bit hash of its vector; equal hashes of different vectors are refused below.
        classes = materialize(usable.groupBy("v").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"), F.min(F.sha2("unit", 256)).alias("h"), F.max(F.sha2("unit", 256)).alias("g")), "vectors")
        if classes.where("h <> g").limit(1).count():
            raise ValueError("two vectors share a 64-bit hash")
        edges, counts = None, None
        for width, n in sorted((r["d"], r["n"]) for r in classes.groupBy(F.length("unit").alias("d")).agg(F.count("*").alias("n")).collect()):
            found = _links_of_width(classes.where(F.length("unit") == width).select("v", "w", "unit"), width // 8, n, cosine, spark)
            e = found.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))
            c = found.select("v", "n")
            edges, counts = (e, c) if edges is None else (edges.union(e), counts.union(c))
        if edges is None:
            keep.append(encoded)
            dead = encoded.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
            return dead.withColumn("kept", F.lit(True))
        components = connected_components(edges, "vectors")
        joined = classes.select("v", "w", "least").join(counts.groupBy("v").agg(F.sum("n").alias("n")), "v", "left").join(components.select(F.col("id").alias("v"), "component"), "v", "left")
        joined = materialize(joined.select("v", "w", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "v").alias("component")), "vector-components")
        named = materialize(joined.groupBy("component").agg(F.min("least").alias("component_id")), "vector-names")
        of_class = materialize(joined.join(named, "component").select("v", (F.col("n") + F.col("w") - 1).alias("n_links"), "component_id"), "vector-classes")
        keep += [encoded, of_class]
    out = encoded.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("v")).alias("v")).join(of_class, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links_of_width(classes: DataFrame, dims: int, n: int, cosine: float, spark) -> DataFrame:
    part = min(1.0, SAMPLE / max(n, 1))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(5), "v"), F.lit(1 << 30)) <= int(part * (1 << 30))).select("v", "unit").toPandas().sort_values("v")
    x = _unit(sample["unit"]) if len(sample) else np.zeros((1, dims))
    mean = x.mean(0)
    agree = agreement(x, mean, cosine)
    bits, tables = plan_tables(n, cosine, agree)
    width = max(bits * tables, CODE)
    rotations = np.concatenate([learn_rotation(x - mean, seed) for seed in range(math.ceil(width / dims))], axis=1)[:, :width]
    sent = spark.sparkContext.broadcast((mean, rotations))
    place = 1 << np.arange(bits, dtype=np.int64)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, r = sent.value
        for b in batches:
            if len(b):
                on = (_unit(b["unit"]) - centre) @ r >= 0
                pieces = (on[:, : bits * tables].reshape(len(b), tables, bits) * place).sum(2)
                yield b.assign(code=[p.tobytes() for p in np.packbits(on[:, :CODE], axis=1)], pieces=[p.tobytes() for p in pieces], keys=list(pieces))

    coded = classes.mapInPandas(code, "v long, w long, unit binary, code binary, pieces binary, keys array<long>")
    placed = coded.select("v", "w", "unit", "code", "pieces", F.posexplode("keys").alias("t", "key"))
    buckets = materialize(placed.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    cells = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = placed.join(buckets, ["t", "key"]).withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64(F.lit(3), "v"), F.col("cells")).cast("int"))
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumns({"i": F.least("cell", "o"), "j": F.greatest("cell", "o")})
    blocks = other.select("t", "key", "i", "j", "cell", "v", "w", "unit", "code", "pieces")
    return materialize(blocks.groupBy("t", "key", "i", "j").applyInPandas(_find(cosine, hamming_radius(agree)), "v long, n long, root long"), "vector-links")


def brute_force(ids: list[int], vectors: list, cosine: float = COSINE) -> list[tuple]:
    """The same rows from all pairs."""
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vectors]
    x = [np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)) if o else None for v, o in zip(vectors, ok)]
    links = [[j for j in range(len(ids)) if j != i and ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine] for i in range(len(ids))]
    least = list(ids)
    for _ in ids:
        new = [min([least[i], *(least[j] for j in links[i])]) for i in range(len(ids))]
        if new == least:
            break
        least = new
    return [(ids[i], len(links[i]), least[i], ids[i] == least[i]) for i in range(len(ids))]
