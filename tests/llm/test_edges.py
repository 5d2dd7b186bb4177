"""Large ids beside nulls, time zones, clashing names, stores that live on, and rules that are checked against plain search."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from onomast.llm import binary_codes, decontaminate, disclosure, mixing, near_dup, repeated_passages, shard_store, toxicity, warc
from onomast.llm.textbuf import CHECK_INVERSE, check_prefix, prefix_hashes, span_hashes
from onomast.plans.shared import materialize, scratch, shared_dir

BIG = 2**53 + 1


def ids(frame, column):
    return sorted((r[0] for r in frame.select(column).collect()), key=lambda i: (i is None, i))


@pytest.mark.parametrize("operator", [near_dup.near_duplicates, repeated_passages.remove_repeats, lambda d: disclosure.span_digest(disclosure.find_spans(d)), mixing.mix])
def test_large_ids_beside_a_null(spark, operator):
    text = "so many words that are the same in both of the documents " * 20
    rows = [(BIG, text, "a"), (None, "x", None), (BIG + 2, text + " end", "a"), (2**63 - 1, None, "a"), (-(2**63), "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    assert ids(operator(docs), "doc_id") == [-(2**63), BIG, BIG + 2, 2**63 - 1, None]


def test_ids_of_documents_may_be_strings(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "ONE two three four five six"), (None, None)], "doc_id string, text string")
    assert {tuple(r)[:4] for r in near_dup.near_duplicates(docs).collect()} == {("a", 2, "a", True), ("b", 2, "a", False), (None, 0, None, True)}
    assert ids(repeated_passages.remove_repeats(docs), "doc_id") == ["a", "b", None]


def test_archives_of_any_page_id_in_any_zone(spark):
    pages = [(10**13, "http://a.com/1", "x" * 200), (2**63 - 1, "http://a.com/2", "x" * 200), (-5, "http://a.com/3", None), (BIG, None, "y"), (None, "http://a.com/4", "x" * 200), (0, "http://a.com/0", "z")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    try:
        for z in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", z)
            found.append([tuple(r) for r in warc.archive_and_index(frame).drop("archive", "offset").collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))
    rows = {r[2]: r for r in found[1]}
    assert set(rows) == {p[0] for p in pages} and rows[0][1] == "2024-01-01T00:00:00Z" and rows[-5][1] == "2024-12-31T23:59:55Z"
    assert {r[1][:4] for r in found[1]} == {"2024"} and rows[2**63 - 1][-1] == 10**13 and rows[None][-1] == 10**13


def test_capture_dates_of_a_column(spark):
    rows = [(1, "http://a.com", "x", "1969-12-31 23:59:59"), (2, "http://a.com", "y", None), (3, "http://a.com", "z", "2000-02-29 12:00:00")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r["page_id"]: r["ts"] for r in warc.archive_and_index(frame, ts="at").collect()}
    assert got == {1: "1969-12-31T23:59:59Z", 2: "2024-01-01T00:00:02Z", 3: "2000-02-29T12:00:00Z"}


def test_merge_in_passes():
    rng = random.Random(1)
    rows = [("k", "t", i, f"a{i % 9}", i) for i in range(300)]
    rng.shuffle(rows)
    runs = [sorted((r for r in rows if r[3] == f"a{k}"), key=warc.order_key) for k in range(9)]
    assert list(warc.merge_runs(runs, fan_in=2)) == sorted(rows, key=warc.order_key)


def test_second_hash_of_spans():
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 3, 3000).astype(np.uint8)
    raw[2000:2500] = raw[100:600]
    p, q = prefix_hashes(raw), check_prefix(raw)
    s, e = np.array([100, 2000, 101]), np.array([600, 2500, 601])
    first, second = span_hashes(p, s, e), span_hashes(q, s, e - 7, CHECK_INVERSE)
    assert first[0] == first[1] != first[2] and second[0] == second[1] != second[2]
    raw[2499] ^= 1
    assert span_hashes(check_prefix(raw), s, e - 7, CHECK_INVERSE)[1] != second[0]


def test_sets_of_one_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "set_key", lambda s: 7)
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "quite another text of words"), (4, "one more text that differs here")]
    sign = near_dup._sign

    def keyed(batches):  # workers don't see the patch above
        for b in sign(batches):
            yield b.assign(vertex=b["vertex"].where(b["vertex"].isna(), 7))

    monkeypatch.setattr(near_dup, "_sign", keyed)
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_flow_is_greatest_and_then_cheapest():
    rng = random.Random(3)
    for _ in range(150):
        sources = ["a", "b", "c"][: rng.randrange(1, 4)]
        patterns = {i: (rng.randrange(0, 4), rng.sample(sources, rng.randrange(1, len(sources) + 1))) for i in range(rng.randrange(1, 4))}
        quotas = {s: rng.randrange(0, 7) for s in sources}

        def fits(used):
            groups = (set(g) for k in range(1, len(sources) + 1) for g in itertools.combinations(sources, k))
            return all(sum(u for u, (_, m) in zip(used, patterns.values()) if set(m) <= g) <= sum(quotas[s] for s in g) for g in groups)

        def cost(used):
            return sum(sum(1 + w // n for w in range(u)) for u, (n, _) in zip(used, patterns.values()) if n)

        best = min((-sum(used), cost(used)) for used in itertools.product(*(range(3 * n + 1) for n, _ in patterns.values())) if fits(used))
        flow = [*mixing.min_cost_flow(patterns, quotas).values()]
        assert fits(flow) and (-sum(flow), cost(flow)) == best, (patterns, quotas, flow)


def test_a_long_document_does_not_spoil_the_mix(spark):
    rng = random.Random(5)
    rows = [(i, "w " * 50, "a") for i in range(4000)] + [(5000 + i, "w " * 30_000, "a") for i in range(3)] + [(9000 + i, "w " * rng.randrange(1, 99), "b") for i in range(4000)]
    for seed in (11, 12, 13):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=seed).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
        assert len(got) == 2 and all(abs(r["taken"] - r["target"]) <= 100 for r in got), got


def test_many_blocks_of_a_benchmark(spark):
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(40)]
    docs = [(i, " ".join(words[i * 15 : i * 15 + 200])) for i in range(20)] + [(99, None)]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.find_hits(frame, benchmark, "doc_hits", block_bytes=200, chained=3)
    got = sorted(tuple(r) for r in decontaminate.contamination(hits, "doc_hits").drop("text").collect())
    assert got == sorted(decontaminate.brute_force(docs, items))


def test_hamming_radius_and_recall(spark):
    agree = np.array([0.9])
    assert 25 <= binary_codes.hamming_radius(agree) <= 33
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(1500, 64)))
    e = rng.normal(size=a.shape)
    b = 0.9505 * a + (1 - 0.9505**2) ** 0.5 * unit(e - (e * a).sum(1, keepdims=True) * a)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate([a, b]).tolist())], "vec_id long, embedding array<double>")
    got = binary_codes.near_vectors(frame)
    assert got.agg(F.sum("n_links")).first()[0] >= 0.99 * 2 * 1500


def test_store_takes_arrivals_and_merges_runs(spark, tmp_path):
    schema = "doc_id long, text string, shard_id string"
    make = lambda lo, hi: spark.createDataFrame([(i, "t" * (i % 700), "mine") for i in range(lo, hi)], schema)
    path, target = f"file://{tmp_path}/store", 20_000
    store, live = shard_store.shard(make(0, 300), path, target)
    for lo, hi in ((300, 360), (360, 420), (420, 421)):
        before = {(r["folder"], r["shard"]) for r in store.manifest().collect()}
        store, live = shard_store.shard(make(lo, hi), path, target)
        after = store.manifest().collect()
        assert live.columns == ["doc_id", "text", "shard_id", "shard_id_"] and sorted(r[0] for r in live.collect()) == list(range(hi))
        assert before & {(r["folder"], r["shard"]) for r in after} and all(r["n_bytes"] <= 2 * target for r in after)
        rows = {r[0]: r[1] for r in live.groupBy("shard_id_").count().collect()}
        assert rows == {r["shard"]: r["n_rows"] for r in after}
    assert any(r["n_rows"] for r in after if not r["arrival"])
    # Tiers: of the runs below the target, no two could be merged.
    small = [r["n_bytes"] for r in after if r["n_bytes"] < target]
    tiers = {}
    for n in small:
        tiers.setdefault(n.bit_length(), []).append(n)
    assert all(len(t) == 1 or sum(t) > target for t in tiers.values())


def test_packing_against_a_plain_loop(spark, tmp_path):
    rng = random.Random(8)
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/store")
    rows = [(f"s{i}", "f", i % 2 == 0, 1, rng.choice([3, 90, 100, 120, 400, 1000, 2000])) for i in range(200)]
    got = {r["shard"]: r["run"] for r in store.plan(spark.createDataFrame(rows, shard_store.MANIFEST), 1000).collect()}
    placed = spark.createDataFrame(rows, shard_store.MANIFEST).withColumns({"h": F.xxhash64("shard", "folder"), "tier": F.floor(F.log2("n_bytes"))}).where("n_bytes < 1000")
    total = sum(r[4] for r in rows if r[4] < 1000)
    groups, runs, filled = max(1, total // (shard_store.GROUP_TARGETS * 1000)), {}, {}
    for r in sorted(placed.collect(), key=lambda r: r["h"]):
        key = (r["tier"], r["h"] % groups)
        runs.setdefault((*key, filled.get(key, 0) // 1000), []).append(r)
        filled[key] = filled.get(key, 0) + r["n_bytes"]
    want = {r["shard"]: f"v1-{t}-{g}-{n}" for (t, g, n), members in runs.items() if len(members) > 1 or members[0]["arrival"] for r in members}
    assert got == want


def test_writers_that_die_or_lose_a_race(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, "t" * 500) for i in range(100)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    store, live = shard_store.shard(frame, path, 10_000)
    version, rows = store.version(), sorted(live.select("doc_id").collect())
    commit = shard_store.ShardStore.commit

    def dies(self, manifest, number):
        raise KeyboardInterrupt

    for step in ("append", "compact"):  # files are written, the version isn't
        monkeypatch.setattr(shard_store.ShardStore, "commit", dies)
        if step == "compact":
            monkeypatch.undo()
            store.append(frame.limit(30), 10_000)
            version, rows = store.version(), sorted(store.rows(frame.schema).select("doc_id").collect())
            monkeypatch.setattr(shard_store.ShardStore, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            store.append(frame, 10_000) if step == "append" else store.compact(frame.schema, 10_000)
        assert store.version() == version and sorted(store.rows(frame.schema).select("doc_id").collect()) == rows
    monkeypatch.undo()

    def after_another(self, manifest, number):  # another writer takes the number first
        monkeypatch.setattr(shard_store.ShardStore, "commit", commit)
        commit(self, self.manifest(), number)
        return commit(self, manifest, number)

    monkeypatch.setattr(shard_store.ShardStore, "commit", after_another)
    assert store.append(frame.limit(1), 10_000) == version + 2
    gone = store.manifest().limit(1)
    gone = spark.createDataFrame(gone.select("folder", "shard").collect(), "folder string, shard string")
    store.publish(spark.createDataFrame([], shard_store.MANIFEST), gone)
    with pytest.raises(shard_store.Conflict):
        store.publish(spark.createDataFrame([], shard_store.MANIFEST), gone)
    with pytest.raises(FileExistsError):
        store.commit(store.manifest(), 1)
    n = store.rows(frame.schema).count()
    store.vacuum()
    with pytest.raises(FileExistsError):  # a number is taken once, whether its version is still there or not
        store.commit(store.manifest(), 1)
    assert store.versions() == [version + 3] and store.rows(frame.schema).count() == n


def test_interaction_and_inner_fold():
    rng = np.random.default_rng(9)
    n = 1500
    terms = [np.unique(np.concatenate([rng.integers(100, 4000, 30), [1] * (rng.random() < 0.4), [2] * (rng.random() < 0.4)])).astype(np.int64) for _ in range(n)]
    label = np.array([float(1 in t and 2 in t) for t in terms])
    row, term = np.repeat(np.arange(n), [len(t) for t in terms]), np.concatenate(terms)
    assert toxicity.choose_cut(row, term, label, np.arange(n) % 5 == 0) in toxicity.CUTS
    model = toxicity.fit(row, term, label)
    assert ((model.scores(row, term, n) >= 0.5) == label).mean() > 0.97
    assert toxicity.choose_cut(row, term, np.zeros(n), np.arange(n) % 5 == 0) == toxicity.CUTS[-1]


def test_spans_of_a_text_with_thousands_of_matches(spark):
    text = " ".join(f"u{i}@x.org 10.0.{i % 256}.1 word" for i in range(1500))
    got = spark.createDataFrame([(1, text)], "doc_id long, text string").select(disclosure.base_spans(F.col("text")).alias("b")).first()["b"]
    at, want = 0, []
    for i in range(1500):
        for kind, piece in ((0, f"u{i}@x.org"), (1, f"10.0.{i % 256}.1"), (None, "word")):
            if kind is not None:
                want.append((at, kind, at + len(piece)))
            at += len(piece) + 1
    assert [tuple(s) for s in got if s["kind"] < 2] == want


def test_scratch_tables_go_and_a_cluster_needs_a_folder(spark, monkeypatch):
    import os

    with scratch() as keep:
        a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
        keep.append(b)
    assert b.count() == 4 and not os.path.exists(a.scratch.removeprefix("file://")) and os.path.exists(b.scratch.removeprefix("file://"))
    if not spark.conf.get("spark.checkpoint.dir", None):
        monkeypatch.setattr(type(spark.sparkContext), "master", "spark://host:7077")
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(spark)
