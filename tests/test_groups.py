"""Groups, canonical names, near misses and the whole proposal on worked examples."""

import pytest
from pyspark.sql import functions as F

from onomast.operators import artifact, canonical, cluster, model, nearmiss
from onomast.operators import profile as prof
from onomast.operators.propose import apply_mapping, propose, propose_csv, propose_groups


def counts(spark, names):
    return spark.createDataFrame([(n, 1) for n in names], "name string, occurrences long")


def groups(spark, names, method="damerau"):
    rows = cluster.group_names(spark.createDataFrame([(n,) for n in names], "name string"), method).select("name", "group").collect()
    out = {}
    for n, g in rows:
        out.setdefault(g, set()).add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("names,expected", [
    (["abcdef1", "abcde1", "abcdeg1"], 3), (["axbcdef1", "abcdef1", "abcdyef1"], 1), (["SampleA", "SampleAA"], 2), (["USMB1", "SMB1"], 2),
    (["ctrls_1", "ctrl_1"], 2), (["malaria5#02", "malaria5#2"], 1), (["p111", "p112"], 2), (["wt_1", "wnt_1"], 2), (["Primary B cells1", "Primary T cellss1"], 2),
    (["#", "*"], 2), (["p1b1", "p1_b1"], 1),
])
def test_worked_groups(spark, names, expected):
    assert len(groups(spark, names)) == expected


def test_index_finds_every_link_of_the_naive_plan(spark):
    import random

    rng = random.Random(5)
    words = ["sample", "patient", "ctrl", "wildtype", "ko", "batch", "rep", "donor", "s", "p", "b", "tec", "mono"]
    made = set()
    for _ in range(250):
        parts = [rng.choice(words) + rng.choice(["", "_", "-"]) + rng.choice(["", str(rng.randrange(3)), f"{rng.randrange(3):03}"]) + rng.choice(["", "", "+", "'"]) for _ in range(rng.randrange(1, 4))]
        name = rng.choice("_-. ").join(parts)
        if rng.random() < 0.5 and len(name) > 3:
            i = rng.randrange(len(name) - 1)
            name = rng.choice([name[:i] + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + "x" + name[i + 1 :]])
        made.add(rng.choice([name, name.upper(), name.capitalize()]))
    frame = spark.createDataFrame([(n,) for n in made], "name string")
    vertex = {r["name"]: r["vertex"] for r in cluster.with_features(frame).collect()}
    featured = cluster.with_features(frame).dropDuplicates(["vertex"]).drop("name")
    indexed = {frozenset(r) for r in cluster._links(featured, "damerau", 0.85).collect()}
    naive = {frozenset((vertex[a], vertex[b])) for a, b in cluster.naive_groups(frame).collect()}
    assert indexed == {p for p in naive if len(p) == 2}


CATALOGUE = {
    "one": ["donor 7", "Donor_07", "DONOR-7", "donro_7"],
    "two": ["donor_71"],
    "three": ["s3_b1", "sample3.batch1", "samp03 bat01", "S3-B1"],
    "four": ["s3_b2"],
    "five": ["cd4+_r1", "CD4\u207a rep1"],
    "six": ["cd4-_r1"],
}
TYPOS = ["patient1_batch1", "patietn1_batch1", "patient1_bacth1", "patinet1_batch1", "patient2_batch1"]


def test_catalogue(spark):
    truth = {n: k for k, names in CATALOGUE.items() for n in names}
    m = propose(counts(spark, truth), method="damerau")
    assert sorted(sorted({truth[x] for x in g.members}) for g in m.groups) == sorted([k] for k in CATALOGUE)
    assert m.summary()["merges"] == 3 and {g.final for g in m.groups if g.is_merge} == {"donor7", "sample3_batch1", "cd4+_replicate1"}


@pytest.mark.parametrize("names,method,n,merges,near", [(TYPOS, "rules", 5, 0, None), (TYPOS, "damerau", 2, 1, None), (["patient11", "patient111", "patient112"], "damerau", 3, 0, 2), (["Sample_1", "sample-01", "sample1", "sample_2"], "rules", 2, 1, None), (["sample_1", "sample_2", "sample_3"], "auto", 3, 0, None)])
def test_summaries(spark, names, method, n, merges, near):
    s = propose(counts(spark, names), method=method).summary()
    assert s["groups"] == n and s["merges"] == merges and (near is None or s["near_misses"] == near)


def test_near_misses(spark):
    def near(names):
        f = cluster.with_features(spark.createDataFrame([(n,) for n in names], "name string"))
        return sorted(tuple(r) for r in nearmiss.reported_pairs(f).collect())

    assert near([f"sample_{i}" for i in [*range(1, 13), 100]]) == [("sample_10", "sample_100")]
    assert near(["patient11_batch2", "patient1_batch1"]) == []
    assert near([f"plate_{c}07" for c in "ABCDEFGH"]) == []
    assert near(["plate_A07", "plate_B07"]) == [("plate_A07", "plate_B07")]
    big = "9" * 45
    assert near([f"s{big}", f"s{big}9"]) == [(f"s{big}", f"s{big}9")]


def test_canonical_prefers_the_medoid_and_the_corpus(spark):
    table = propose_groups(counts(spark, ["patient1", "patietn1", "patint1", "sample_1", "sampel_1", "sample_2", "sample_3"])).collect()
    assert {r["proposed"] for r in table} == {"patient1", "sample1", "sample2", "sample3"}
    assert [r["id"] for r in sorted(table, key=lambda r: r["members"])] == [1, 2, 3, 4]


def test_profile(spark):
    row = prof.profile(spark.createDataFrame([("s1_b",), ("S-01",)], "name string")).first().asDict()
    assert row == {"delimiter_mix": True, "abbreviations_detected": ["sample (s<n>)"], "zero_padding": True, "case_mix": True, "verdict": "inconsistencies_found"}
    empty = prof.profile(spark.createDataFrame([], "name string")).first().asDict()
    assert empty == {"delimiter_mix": False, "abbreviations_detected": [], "zero_padding": False, "case_mix": False, "verdict": "appears_consistent"}


def test_model_guard_keeps_numbers_apart(spark):
    fake = lambda names: {"canonical_pattern": "x", "mapping": dict.fromkeys(names, "patient111")}
    m = propose(counts(spark, ["patient111", "patient112", "Patient_111"]), method="llm", proposer=fake)
    assert [(g.members, g.final) for g in m.groups] == [(["Patient_111", "patient111"], "patient111"), (["patient112"], "patient112")]
    assert not m.collisions()
    auto = propose(counts(spark, ["ctrl_1", "kontrol_1", "patient2"]), method="auto", proposer=lambda names: {"mapping": {n: "control1" if "tr" in n else n for n in names}})
    assert [(g.members, g.final) for g in auto.groups][0] == (["ctrl_1", "kontrol_1"], "control1")
    with pytest.raises(ValueError):
        model.check_answer({"mapping": {"a": None}}, ["a"])


def test_apply_round_trip(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_bytes(b"\xef\xbb\xbfsample_id,note,note\r\nS_01,\"a,b\",x\r\ns1,,\r\n\r\nNA,z\r\n")
    m = propose_csv(spark, source, "sample_id", method="damerau")
    with pytest.raises(ValueError):
        m.final_mapping()
    m.accept_all()
    path = tmp_path / "m.json"
    artifact.write(m, path)
    again = artifact.read(path)
    _, log = apply_mapping(spark, again, output_path=tmp_path / "out.csv", json_log_path=tmp_path / "log.json", csv_log_path=tmp_path / "log.csv")
    assert (tmp_path / "out.csv").read_bytes() == b"sample_id,note,note,sample_id_canonical\r\nS_01,\"a,b\",x,sample1\r\ns1,,,sample1\r\n,,,\r\nNA,z,,na\r\n"
    assert log["summary"]["rows_changed"] == 3 and log["summary"]["total_rows"] == 4
    with pytest.raises(ValueError):
        apply_mapping(spark, again, output_path=source)
    collided = artifact.groups_frame(spark, again)
    assert artifact.collisions_frame(collided).count() == len(again.collisions())


@pytest.mark.parametrize("content,message", [(b"a,b\n1,2,3\n", "line 2"), (b"a,b\n1,\x002\n", "NUL"), (b"a,b\n\"1,2\n", "read as CSV"), (b"a,a\n1,2\n", "columns named"), (b"x\ty\n1\t2\n", "tabs"), (b"b\n1\n", "no column"), (b"a\n\xff\n", "not utf-8")])
def test_refusals(spark, tmp_path, content, message):
    p = tmp_path / "x.csv"
    p.write_bytes(content)
    with pytest.raises(ValueError, match=message):
        propose_csv(spark, p, "a", method="rules")


def test_stream_apply(spark, tmp_path):
    from onomast.streaming import apply_stream

    spark.createDataFrame([("S_1",), ("x",)], "name string").write.parquet(str(tmp_path / "in"))
    lookup = spark.createDataFrame([("S_1", "sample1", 1)], "original string, canonical string, group int")
    stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    q = apply_stream(stream, "name", lookup).writeStream.format("memory").queryName("applied").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("applied").collect()} == {("S_1", "sample1"), ("x", "x")}
    assert spark.range(1).select(F.lit(1)).count() == 1 and canonical is not None
