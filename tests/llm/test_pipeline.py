"""The pipeline's stages on a small corpus, each held against brute force on its own input."""

import random

from onomast.llm import decontaminate, mixing, near_dup
from onomast.plans.shared import materialize


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item = say(20)
    rows = [(i, say(rng.randrange(8, 60)) + (" scum idiot" if i % 9 == 0 else ""), "en", f"s{i % 3}", "x") for i in range(400)]
    toxic = {i for i in range(400) if i % 9 == 0}
    copies = [(1000 + i, rows[i + 1][1] + (" tail" if i % 2 else ""), "en", "s1", "x") for i in range(60)]
    leaked = [(2000 + i, f"{say(5)} {item} {say(5)}", "en", "s2", "x") for i in range(5)]
    leaked += [(2005, f"{say(1200)} {' '.join(item.split()[3:16])} {say(800)}", "en", "s2", "x")]
    edges = [(3000, None, "en", "s0", "x"), (3001, "", "en", None, "x"), (1, rows[1][1], "en", "s1", "x"), (None, say(30), "en", "s0", "x")]
    schema = "doc_id long, text string, lang string, source string, score string"
    spark.createDataFrame(rows + copies + leaked + edges, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, inputs = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        inputs[name] = d
        d = materialize(stage(spark, d, str(tmp_path)), "test-stage")
        if name != "sharding":
            assert d.columns == inputs[name].columns
    ids = lambda frame: sorted(r[0] for r in frame.select("doc_id").where("doc_id is not null").collect())
    kept = set(ids(inputs["near_duplicates"]))
    assert not kept & {i for i in toxic if i % 9 == 0 and i > 0} and kept >= set(range(400)) - toxic
    pairs = [tuple(r) for r in inputs["near_duplicates"].where("doc_id is not null").select("doc_id", "text").distinct().collect()]
    assert ids(inputs["decontamination"]) == sorted(x[0] for x in near_dup.brute_force(pairs) if x[3])
    pairs = [tuple(r) for r in inputs["decontamination"].where("doc_id is not null").select("doc_id", "text").collect()]
    clean = sorted(x[0] for x in decontaminate.brute_force(pairs, [(1, item)]) if not x[2])
    assert ids(inputs["mixing"]) == clean and not set(clean) & {2000 + i for i in range(6)}
    taken = mixing.mix(inputs["mixing"]).where("size > 0").selectExpr("doc_id", "taken div size as n").collect()
    assert sorted(x["doc_id"] for x in taken for _ in range(x["n"]) if x["doc_id"] is not None) == ids(inputs["sharding"])
    assert sorted(map(str, d.select(inputs["sharding"].columns).collect())) == sorted(map(str, inputs["sharding"].collect()))
    assert cp.run(spark, str(tmp_path)).count() == d.count()


def test_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    a, b, big = "one two three four five six seven eight nine ten", "quite another text with other words in it altogether", 2**53 + 1
    near = f"{a} eleven"
    rows = [(1, a), (2, b), (2, a), (3, a), (3, a), (7, near), (7, near), (7, b), (None, "no one has this id but here it is"), (None, "no one has this id but here it is"), (None, "no one has this id but here it is now"), (None, None), (None, None), (4, None), (4, ""), (big, "z " * 9), (big + 1, "y " * 9)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, source string, row int, other int, __text int").coalesce(1)
    out = cp.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    nameless = [t for i, t in kept if i is None and t]
    assert len(nameless) == 1 and nameless[0].startswith("no one")
    assert [x for x in kept if x[1] not in nameless] == sorted([(1, a), (2, b), (None, None), (None, None), (4, None), (4, ""), (big, "z " * 9), (big + 1, "y " * 9)], key=str)


def test_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    names = "hits int, pattern int, copies int, runs int, words int, again int, row int, other int, shard_id int, member int, __order int, __label int, place int, score int, group_key int, text_hash int"
    schema = f"doc_id long, text string, source string, {names}"
    rows = [(i, f"plain words number {i} of some kind that nobody else says {i * 7}", "a", *range(16)) for i in range(20)]
    spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of more than thirteen words which none of the documents has in any place")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES:
            docs = materialize(stage(spark, docs, str(tmp_path)), "clash")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")] + ["shard_id_"] * (name == "sharding")
        assert data == [] or docs.count() > 0


def test_registration_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in e.queries()}
    monkeypatch.setattr(e, "_llm", lambda: None)
    assert e.queries() and not any(k.startswith("op1_") or k == "pipeline" for k in e.queries())
