"""Near duplicates, repeated passages, vectors, archives and shards against brute force, with the defined edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from onomast.llm import binary_codes, near_dup, repeated_passages, shard_store, warc

SCHEMA = "doc_id long, text string, n_shingles long, kept boolean, vertex long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, False, 2) for i, t in rows], SCHEMA)


def planted(rng, groups=8, size=30):
    """Groups of texts with edits of all sizes around the threshold."""
    out, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append((n, (" " if rng.random() < 0.5 else "\t").join(w).upper() if rng.random() < 0.3 else " ".join(w)))
            n += 1
    return out


@pytest.mark.parametrize("region", [24, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(near_dup, "REGION", region)  # 2: nearly all regions descend to full depth
    rows = planted(random.Random(region), groups=5 if region == 2 else 8)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, "one two three four five"), (9005, "one two three four five"), (9006, "long " * 40000)]
    got = sorted(tuple(r)[:4] for r in near_dup.near_duplicates(docs(spark, rows)).collect())
    want = sorted(near_dup.brute_force(rows))
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert len(got) == len(want) and not wrong, wrong[:5]


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    got = near_dup.near_duplicates(docs(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, "q"), (None, None)])).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in got))) == sorted(map(str, [(None, 7, False), (7, 7, True), (None, None, True), (None, None, True)]))


@pytest.mark.parametrize("group", [4096, 3])
def test_repeated_passages_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeated_passages, "GROUP", group)  # 3: most ends of passages are counted as single strings
    rng = random.Random(group)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):
        t = rng.choice(base)
        a, n = rng.randrange(len(t) - 700), rng.choice([380, 398, 399, 400, 401, 420, 520, 640])
        rows.append((100 + i, word() * rng.randrange(9) + t[a : a + n] + word() * rng.randrange(9)))
    rows += [(900, "ab" * 500), (901, None), (902, ""), (903, "x" * 400), (904, "x" * 399), (905, base[0][:500] * 2), (906, base[1]), (None, base[2]), (907, "y" * 400)]
    got = sorted(map(str, (tuple(r) for r in repeated_passages.remove_repeats(docs(spark, rows)).collect())))
    want = sorted(map(str, (tuple(r) for r in repeated_passages.brute_force(rows))))
    assert got == want
    assert repeated_passages.remove_repeats(docs(spark, [])).count() == 0


def test_planted_passages_are_caught_from_400_bytes_on_and_nothing_else_is(spark):
    rng = random.Random(51)
    words = lambda n, length: " ".join("".join(rng.choices("abcdefghijklmnopéü", k=length)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):  # 51 to 62 words each, of 3 letters (below 400 bytes) or of 9
        passage = words(51 + i, 3 if i % 2 else 9)
        assert (len(passage.encode()) < 398) == bool(i % 2)
        for side in "xyz"[: rng.choice([2, 3])]:
            doc = len(rows)
            before, after = f"{words(60, 6)} {side}", f"{side} {words(60, 6)}"
            want[doc] = (0, 0, f"{before} {passage} {after}") if i % 2 else (len(passage.encode()) + 2, 1, before + after)
            rows.append((doc, f"{before} {passage} {after}"))
    rows += [(1000 + i, words(rng.randrange(40, 200), 6)) for i in range(12)]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeated_passages.remove_repeats(docs(spark, rows)).collect()}
    for doc, text in rows:
        removed, spans, kept = want.get(doc, (0, 0, text))
        # n_bytes is the text's own length whatever is removed, so a passage found can't be read from it.
        assert got[doc] == (len(text.encode()), removed, spans, hashlib.sha256(kept.encode()).hexdigest()), doc


def test_hash_compared_sort():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randrange(1, 200)
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(n)]
        group = np.array([rng.randrange(3) for _ in range(n)])
        order, gap = repeated_passages.Suffixes(strings, group).sorted_with_extensions()
        assert order.tolist() == sorted(range(n), key=lambda i: (group[i], strings[i], i))
        for k in range(1, n):
            a, b = order[k - 1], order[k]
            common = next((j for j, (x, y) in enumerate(zip(strings[a], strings[b])) if x != y), min(len(strings[a]), len(strings[b])))
            assert gap[k] == (common if group[a] == group[b] else -1)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(40):
        centre = rng.normal(size=16)
        vectors += [(centre + rng.normal(size=16) * s).tolist() for s in (0.05, 0.15, 0.25, 0.3, 0.35)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(len(vectors)))
    frame = spark.createDataFrame(list(zip(ids, vectors, [0] * len(ids), [1] * len(ids))), "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(tuple(r) for r in binary_codes.near_vectors(frame).collect())
    want = sorted(binary_codes.brute_force(ids, vectors))
    links = sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.99 * links > 200
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(want) and [g[0] for g in got] == ids
    assert binary_codes.near_vectors(frame.limit(0)).count() == 0
    assert binary_codes.near_vectors(frame.where("vec_id = 203")).collect()[0][1:] == (0, 203, True)


def test_vectors_in_many_buckets_and_cells(spark, monkeypatch):
    monkeypatch.setattr(binary_codes, "BUCKET", 8)
    monkeypatch.setattr(binary_codes, "BLOCK", 8)
    rng = np.random.default_rng(2)
    vectors = [v for _ in range(30) for c in [rng.normal(size=24)] for v in (c + rng.normal(size=(20, 24)) * 0.1).tolist()]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in binary_codes.near_vectors(frame).collect())
    want = sorted(binary_codes.brute_force(list(range(len(vectors))), vectors))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))


def test_archives(spark):
    long = "<p>" + "é" * 100 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(5, "http://b.com/x?b=2&a=1", long), (3, "https://www.a.com", long), (9, None, long), (3, "http://a.com/", "short"), (4, "not a url", "short"), (7, "http://[bad", None), (8, "http://a.com/z\r\nInjected: 1", ""), (None, "http://a.com/q", long), (3, "https://www.a.com", long)]
    frame = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, record_type string")
    rows = warc.archive_and_index(frame).collect()
    assert len(rows) == len(pages)
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = sorted(map(str, ((i, len((h or "").encode()), sha(h), "revisit" if h == long and i != 3 else "response", 3 if h == long and i != 3 else None) for i, _, h in pages)))
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows))) == want
    keys = [(r["url_key"], r["ts"]) for r in rows]
    assert keys == sorted(keys) and "com,b)/x?a=1&b=2" in {k for k, _ in keys} and "-" in {k for k, _ in keys}
    assert warc.archive_and_index(frame.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(5)
    for _ in range(100):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(10))]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)
    with pytest.raises(ValueError):
        list(warc.LoserTree([[2, 1]], key=lambda x: x))


def test_damaged_archive_is_refused():
    with pytest.raises(ValueError):
        list(warc.records(memoryview(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")))


def test_shards(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i % 900 if i % 50 else None, None if i % 97 == 0 else "t" * rng.randrange(0, 3000), "s", "mine") for i in range(1000)] + [(5, "big " * 20000, "s", "mine")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, shard_id string").repartition(5)
    target = 20_000
    store, live = shard_store.shard(frame, f"file://{tmp_path}/store", target)
    assert store.versions() == [2]
    assert sorted(map(str, live.select(frame.columns).collect())) == sorted(map(str, frame.collect()))
    manifest = store.manifest().collect()
    assert sum(r["n_rows"] for r in manifest) == len(rows)
    assert sorted(r["n_bytes"] for r in manifest)[-2] <= 2 * target and {c.lower() for c in live.columns} >= {"shard_id", "shard_id_"}
    with pytest.raises(FileExistsError):
        store.commit(store.manifest(), 2)
    store.commit(store.manifest(), 3)
    assert store.version() == 3 and store.manifest(2).count() == store.manifest().count()
    _, none = shard_store.shard(frame.limit(0))
    assert none.count() == 0 and none.columns == live.columns
