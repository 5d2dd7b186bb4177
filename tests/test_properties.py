"""What must hold for any names and any CSV file: generated, a batch of cases to a Spark job."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from onomast.functions import names as N
from onomast.operators import artifact, cluster, nearmiss
from onomast.operators.propose import apply_mapping, propose, propose_csv
from onomast.sources import strict_csv

WORDS = ["sample", "Samp", "s", "patient", "pt", "P", "batch", "b", "ctrl", "control", "wt", "donor", "cell", "tec", "é", "ß", "Δ", "cd"]


def laboratory_names(seed: int, n: int) -> list[str]:
    """Names as laboratories write them, many of them near each other, some with a slip."""
    rng, out = random.Random(seed), set()
    while len(out) < n:
        parts = [rng.choice(WORDS) + rng.choice(["", "", "_", "-", " "]) + rng.choice(["", f"{rng.randrange(4)}", f"{rng.randrange(30):02}", "٣", "²"]) + rng.choice(["", "", "", "+", "-", "'", "a"]) for _ in range(rng.randrange(1, 4))]
        name = rng.choice(["_", "-", ".", " ", ""]).join(parts)
        if len(name) > 4 and rng.random() < 0.4:
            i = rng.randrange(len(name) - 1)
            name = rng.choice([name[:i] + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + rng.choice("xqe") + name[i + 1 :], name.upper()])
        if name.strip():
            out.add(name)
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    names = laboratory_names(1, 400)
    counts = spark.createDataFrame([(n, 1 + i % 3) for i, n in enumerate(names)], "name string, occurrences long")
    facts = {r["name"]: r for r in counts.select("name").withColumns(N.features(F.col("name"))).collect()}
    return names, counts, facts


@pytest.mark.parametrize("method", ["rules", "damerau"])
def test_groups(spark, corpus, method):
    names, counts, facts = corpus
    m = propose(counts, method=method)
    assert sorted(x for g in m.groups for x in g.members) == names
    assert all(len({tuple(facts[x]["signature"]) for x in g.members}) == 1 for g in m.groups)
    home = {x: g.id for g in m.groups for x in g.members}
    assert m.near_misses and all(home[a] != home[b] for a, b in m.near_misses)
    assert all(g.proposed.strip() for g in m.groups)
    shuffled = propose(counts.orderBy(F.rand(3)).repartition(5), method=method)
    assert [g.__dict__ for g in shuffled.groups] == [g.__dict__ for g in m.groups] and shuffled.near_misses == m.near_misses
    links = {frozenset((r["a"], r["b"])) for r in cluster.naive_groups(counts.select("name"), method).collect()}
    for pair in links:
        a, b = sorted((facts[x]["letters"] for x in pair), key=len)
        assert len(a) == len(b) or not is_part(a, b)


def is_part(short, long):
    rest = iter(long)
    return all(t in rest for t in short)


@pytest.mark.parametrize("merge_all", [True, False])
@pytest.mark.parametrize("method", ["llm", "auto"])
def test_no_answer_of_a_model_mixes_identities(corpus, method, merge_all):
    names, counts, facts = corpus
    m = propose(counts, method=method, proposer=lambda asked: {"mapping": dict.fromkeys(asked, "sample1") if merge_all else {}})
    assert sorted(x for g in m.groups for x in g.members) == names
    assert all(len({tuple(facts[x]["signature"]) for x in g.members}) == 1 for g in m.groups)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_decisions_keep_every_row_and_column(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = laboratory_names(seed, 60)
    rows = [[rng.choice(names), rng.choice(["", "NA", "007", 'has "quotes"', "a,b", "line\nbreak", " x "])] for _ in range(200)] + [[""], []]
    with open(tmp_path / "in.csv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\r\n").writerows([["name", "note"], *rows])
    m = propose_csv(spark, tmp_path / "in.csv", "name", method="damerau")
    m.decide([(g.id, *rng.choice([("accept", None), ("reject", None), ("edit", f"n{g.id}")])) for g in m.groups])
    m.mark_reviewed()
    apply_mapping(spark, m, output_path=tmp_path / "out.csv")
    raw = (tmp_path / "out.csv").read_bytes()
    assert raw.count(b"\r\n") >= 200 and b"\r\n" == raw[-2:]
    out = [*csv.reader(io.StringIO(raw.decode(), newline=""))]
    final = m.final_mapping()
    want = [[*(r + ["", ""])[:2]] for r in rows]
    assert out[0] == ["name", "note", "name_canonical"] and [r[:2] for r in out[1:]] == want
    assert all(r[2] == final.get(r[0], r[0]) and (r[2].strip() or not r[0].strip()) for r in out[1:])


TEXT = st.text(st.characters(blacklist_characters="\0", blacklist_categories=("Cs",)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(TEXT, min_size=2, max_size=2), max_size=6), st.sampled_from(["utf-8", "utf-8-sig", "utf-16"]))
def test_csv_records_are_those_of_the_csv_module(tmp_path_factory, rows, encoding):
    path = tmp_path_factory.mktemp("csv") / "x.csv"
    with open(path, "w", encoding=encoding, newline="") as f:
        csv.writer(f, quoting=csv.QUOTE_ALL).writerows([["a", "b"], *rows])
    assert [*strict_csv.records(path, encoding)] == [["a", "b"], *rows]


@pytest.mark.parametrize("content,rows", [(b"a,b\n1\n\n2,3", [["1", ""], ["", ""], ["2", "3"]]), (b'a,b\r\n"x\r\ny",\r\n', [["x\r\ny", ""]]), ("a,b\né,ü\n".encode("cp1252"), [["é", "ü"]])])
def test_csv_shapes(tmp_path, content, rows):
    (tmp_path / "x.csv").write_bytes(content)
    assert [*strict_csv.records(tmp_path / "x.csv", "cp1252")][1:] == rows


@pytest.mark.parametrize("content,message", [(b"", "empty"), (b"\na\n", "no header"), (b'a,b\n"x"y,1\n', "read as CSV"), (b'a,b\n"x', "read as CSV"), (b"a\n" + b"x" * 9000 + b"\n\xff\n", "offset 9003"), (b"a\n1,2\n", "line 2")])
def test_csv_that_is_refused(tmp_path, content, message):
    (tmp_path / "x.csv").write_bytes(content)
    with pytest.raises(ValueError, match=message):
        list(strict_csv.records(tmp_path / "x.csv", "utf-8"))


def test_pairs_are_symmetric_and_of_distinct_names(spark, corpus):
    _, counts, _ = corpus
    found = [tuple(r) for r in nearmiss.reported_pairs(cluster.with_features(counts.select("name"))).collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)


def test_documents_survive_their_file(tmp_path, corpus):
    m = propose(corpus[1], method="rules")
    artifact.write(m, tmp_path / "m.json")
    assert artifact.read(tmp_path / "m.json").to_dict() == m.to_dict()
