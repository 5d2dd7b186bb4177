"""Toxicity, token counts, decontamination, mixing and disclosure on small tables, with the defined edge cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from onomast.llm import decontaminate, disclosure, mixing, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, kept boolean, n_words long, shard_id string, component_id long"


def table(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, "en", s, 1.0, True, 5, "x", 7) for i, t, s in rows], DOCS)


EDGES = [(1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, "word " * 30000, "a"), (None, "some words here", "b"), (5, "same text twice over", "b"), (5, "same text twice over", "b"), (6, "same text twice over", "c")]


def test_token_counts_match_plain_greedy_search(spark):
    vocabulary = token_counts.load_vocabulary(token_counts.VOCABULARY)
    tokens, longest, alphabet = set(vocabulary), max(map(len, vocabulary)), token_counts.byte_alphabet()

    def plain(word):
        s, i, n = (*(alphabet[b] for b in word.encode()), token_counts.END_MARK), 0, 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in tokens), None)
            if j is None:
                return 1
            i, n = j, n + 1
        return n

    texts = ["Hello, world! It's 2024.", "Übergrößenträger naïve façade 漢字テスト", "a" * 500, "x²³½ ''' 're", "é = é", *(t for _, t, _ in EDGES if t and len(t) < 1000)]
    rows = table(spark, [*EDGES, *((100 + i, t, "z") for i, t in enumerate(texts))])
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(rows).collect()}
    for i, t in enumerate(texts):
        words = token_counts.WORD.findall(unicodedata.normalize("NFC", t).lower())
        assert (100 + i, len(words), sum(map(plain, words))) in got
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0)} <= got


def test_automaton_on_small_vocabularies():
    from tokenizers import Tokenizer, models

    rng = random.Random(2)
    for _ in range(60):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
        automaton = token_counts.LongestMatch(tuple(v) for v in vocabulary)
        model = Tokenizer(models.WordPiece({v: i for i, v in enumerate(["[UNK]", *sorted(vocabulary)])}, unk_token="[UNK]", continuing_subword_prefix=""))
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            assert automaton.pieces(word) == len(model.encode(word).tokens), (vocabulary, word)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcde") * rng.randrange(1, 3)
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(12)] + [(3, "dup item"), (None, "nobody owns these few words"), (20, None), (21, "..."), (22, "Ünïcode wörds")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            w[5:5] = decontaminate.split_words(rng.choice(items)[1])[rng.randrange(0, 3) :]
        docs.append((i, ", ".join(x.decode() if isinstance(x, bytes) else x.upper() for x in w)))
    docs += [(100, None), (101, ""), (102, "nobody owns these few words"), (103, "ÜNÏCODE WÖRDS"), (104, "ünïcode, wörds")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):
        hits = decontaminate.find_hits(table(spark, [(i, t, "s") for i, t in docs]).select("doc_id", "text"), benchmark, block_bytes=block, chained=2)
        got = sorted(tuple(r) for r in decontaminate.contamination(hits).drop("text").collect())
        assert got == sorted(decontaminate.brute_force(docs, items))
    empty = decontaminate.decontaminate(table(spark, EDGES), benchmark.limit(0))
    assert empty.where("contaminated or n_hit > 0").count() == 0 and empty.count() == len(EDGES)
    assert decontaminate.decontaminate(table(spark, []), benchmark).count() == 0


def test_targets_and_flow():
    assert mixing.targets({"a": 100, "b": 100}, {"a": 1, "b": 3}, 200) == {"a": 50.0, "b": 150.0}
    assert mixing.targets({"a": 10, "b": 1000}, {"a": 2, "b": 1}, 1010) == {"b": 980.0, "a": 30.0}
    flow = mixing.min_cost_flow({0: (100, ["a"]), 1: (100, ["a", "b"]), 2: (100, ["b"])}, {"a": 150, "b": 150})
    assert flow == {0: 100, 1: 100, 2: 100}
    skewed = mixing.min_cost_flow({0: (100, ["a"]), 1: (10, ["b"])}, {"a": 50, "b": 30})
    assert skewed == {0: 50, 1: 30}


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 20), rng.choice(["a", "b", "b", "b", None, ""])) for i in range(3000)] + EDGES
    out = mixing.mix(table(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    taken, sizes = {}, {}
    for r in out:
        key = (r["source_size"], r["target"])
        taken[key] = taken.get(key, 0) + r["taken"]
        sizes[key] = sizes.get(key, 0) + r["size"]
    assert all(sizes[k] == k[0] and abs(n - k[1]) <= max(20, 0.01 * k[1]) or k[0] > 29000 for k, n in taken.items())
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(table(spark, rows).repartition(7)).collect()))
    assert mixing.mix(table(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()} == {0}
    copies = mixing.copies_of(table(spark, rows))
    assert copies.columns == table(spark, []).columns
    assert copies.select(F.sum(mixing.word_count())).first()[0] == sum(r["taken"] for r in out)


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 3 else ["a"]) for i in range(300)], "doc_id long, text string, sources array<string>")
    rows = mixing.mix(docs, F.col("sources")).collect()
    assert len(rows) == 300 and abs(sum(r["taken"] for r in rows) - 3000) <= 40


def test_toxicity(spark):
    rng = random.Random(8)
    neutral = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1500):
        words = rng.choices(neutral, k=rng.randrange(5, 40))
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["zinsult"] * insult + ["zgroup"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(insult and group)))
    truth = {i: t for i, _, t in labels}
    frame = spark.createDataFrame([*labels, (0, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(spark, table(spark, rows + EDGES), frame).collect()
    assert len(out) == len(rows) + len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 6]
    assert len(held) > 200 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    none = toxicity.toxicity(spark, table(spark, EDGES), frame.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and toxicity.toxicity(spark, table(spark, []), frame).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for n, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@d-e.fg", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+12", "@", ".", "-", " ", "é", "漢", "9", "12", "word", "%", "_", "+", "(", "\n", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 25))) for _ in range(400)] + ["a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "7" * 5000, "a" * 3000 + "@", None, ""]
    rows = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: [tuple(s) for s in r["b"]] for r in rows.select("doc_id", disclosure.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t


def test_disclosing_terms(spark):
    rng = random.Random(10)
    common = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choices(common, k=30)), "s") for i in range(200)]
    rows += [(300 + i, f"{' '.join(rng.choices(common, k=12))} Zorblax writes from bob@x.org {' '.join(rng.choices(common, k=12))}", "s") for i in range(6)]
    rows += [(400, "zorblax was seen; alpha", "s"), *EDGES]
    docs = table(spark, rows)
    terms = {r["term"] for r in disclosure.disclosing_terms(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), alpha=0.9).collect()}
    assert "zorblax" in terms and not terms & set(common)
    out = {r["doc_id"]: r for r in disclosure.span_digest(disclosure.find_spans(docs.where("doc_id is not null"), alpha=0.9)).collect()}
    assert "term:0:7" in out[400]["spans"] and out[400]["n_email"] == 0 and out[300]["n_email"] == 1 and out[0]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs, alpha=0.9).collect()}
    assert "bob@x.org" not in clean[300] and "[EMAIL]" in clean[300] and "orblax" not in clean[400] and clean[1] is None and clean[0] == rows[0][1]
    assert disclosure.span_digest(disclosure.find_spans(table(spark, []))).count() == 0


@pytest.mark.parametrize("spans,n", [([], 0), ([(0, 3), (2, 5)], 5), ([(4, 6), (0, 2)], 4)])
def test_union_length(spans, n):
    assert decontaminate.union_length(spans) == n
