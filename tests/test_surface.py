"""The command line, the document's checks, the model's side and the outputs."""

import copy
import http.server
import json
import threading

import pytest

import onomast
from onomast import cli
from onomast.operators import artifact, model, qc
from onomast.operators.apply import overlap
from onomast.operators.propose import apply_mapping, harmonize_csv, names_table, propose, propose_csv

GOOD = {"id": 1, "members": ["a1", "A_1"], "proposed": "a1", "final": "a1", "status": "accepted", "occurrences": {"a1": 2, "A_1": 1}, "method": "damerau", "min_similarity": 1.0}
DOCUMENT = {"schema_version": 1, "groups": [GOOD], "column": "s", "near_misses": [["a1", "a2"]]}


@pytest.fixture(autouse=True)
def session(spark, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    for name in ("OPENROUTER_API_KEY", "OLLAMA_HOST", "OLLAMA_MODEL", "OPENROUTER_MODEL"):
        monkeypatch.delenv(name, raising=False)


def test_exports():
    assert all(callable(getattr(onomast, name)) for name in onomast.__all__)


@pytest.mark.parametrize("value,number", [(7, 7), (7.0, 7), ("7", 7), (" -3 ", -3)])
def test_ids(value, number):
    assert artifact.Group.from_dict(GOOD | {"id": value}).id == number


@pytest.mark.parametrize("field,values", [
    ("id", [True, 1.5, "1.5", None, float("nan"), float("inf"), "x"]), ("members", ["AB", [], [1], [" "], ["a", "a"], None]), ("proposed", ["", " ", 3, None]), ("final", ["", None]),
    ("status", ["open", None]), ("occurrences", [[], {"a": -1}, {"a": True}, {"a": None}, {"a": 1.5}]), ("method", ["", None, 3]), ("min_similarity", [-0.1, 1.1, True, "1"]),
])
def test_groups_that_cannot_be_used(field, values):
    for value in values:
        with pytest.raises(ValueError):
            artifact.Group.from_dict(GOOD | {field: value})
    if field in ("id", "members", "proposed", "final", "status"):
        with pytest.raises(ValueError, match=field):
            artifact.Group.from_dict({k: v for k, v in GOOD.items() if k != field})


def test_groups_made_in_python_pass_the_same_checks():
    assert artifact.Group.from_dict(GOOD | {"occurrences": None}).rows == 0
    with pytest.raises(ValueError):
        artifact.Group(1, "AB", "a", "a", "accepted").resolved()
    g = artifact.Group(1, ["a"], "b", "a", "edited")
    assert g.is_rename and not g.is_noop and artifact.Group(1, ["a"], "a", "b", "edited").is_noop


@pytest.mark.parametrize("change", [
    {"schema_version": 2}, {"groups": {}}, {"groups": [GOOD, GOOD | {"id": 2}]}, {"reviewed": "false"}, {"reviewed": None}, {"near_misses": [["a"]]}, {"near_misses": [["a", " "]]}, {"near_misses": "ab"},
    {"diagnosis": []}, {"encoding": "no-such-codec"}, {"encoding": 3}, {"input_file": 1}, {"column": ["s"]}, {"method": 1},
])
def test_documents_that_cannot_be_used(change):
    with pytest.raises(ValueError):
        artifact.Mapping.from_dict(DOCUMENT | change)


def test_documents_round_trip(tmp_path):
    m = artifact.Mapping.from_dict(DOCUMENT | {"diagnosis": None, "near_misses": None, "encoding": None, "model": None})
    assert m.method == "rules" and m.near_misses == [] and m.encoding == artifact.DEFAULT_ENCODING
    artifact.write(m, tmp_path / "m.json")
    again = artifact.read(tmp_path / "m.json")
    assert again.to_dict() == m.to_dict() and again.source_path == str(tmp_path / "m.json")
    assert [f.name for f in tmp_path.iterdir()] == ["m.json"]
    (tmp_path / "bad.json").write_bytes(b"\xff")
    (tmp_path / "cut.json").write_text("{")
    for name in ("bad.json", "cut.json"):
        with pytest.raises(ValueError, match=name):
            artifact.read(tmp_path / name)


def test_replacing_is_all_or_none(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("old")
    with pytest.raises(RuntimeError):
        with artifact.replacing(a, b) as (x, y):
            x.write_text("new")
            raise RuntimeError
    assert a.read_text() == "old" and not b.exists() and len(list(tmp_path.iterdir())) == 1
    with artifact.replacing(a, b) as (x, y):
        x.write_text("new")
        y.write_text("other")
    assert (a.read_text(), b.read_text()) == ("new", "other") and len(list(tmp_path.iterdir())) == 2


SOURCE = "sample_id\nS1_B1\ns1-b1\nP3_B2\np3-b2\nCTRL_rep1_b1\nctrl-r1-batch1\n"


_PROPOSED: dict = {}


def proposed(spark, tmp_path):
    """The proposal for SOURCE in a folder of its own; made once."""
    (tmp_path / "in.csv").write_text(SOURCE)
    if not _PROPOSED:
        _PROPOSED.update(propose_csv(spark, tmp_path / "in.csv", "sample_id", method="damerau").to_dict())
    m = artifact.Mapping.from_dict(copy.deepcopy(_PROPOSED) | {"input_file": str(tmp_path / "in.csv")})
    artifact.write(m, tmp_path / "m.json")
    return m


@pytest.mark.parametrize("answers,statuses,reviewed", [(["a", "a", "a"], {"accepted"}, True), (["r", "x", "", "r", "r"], {"rejected"}, True), (["e", " ", "new_1", "a", "a"], {"edited", "accepted"}, True), (["A"], {"accepted"}, True), (["a", "q"], {"accepted", "proposed"}, False)])
def test_review(spark, tmp_path, monkeypatch, answers, statuses, reviewed):
    proposed(spark, tmp_path)
    given = iter(answers)
    monkeypatch.setattr("builtins.input", lambda _: next(given))
    monkeypatch.setattr("sys.stdin", type("Terminal", (), {"isatty": lambda self: True})())
    assert cli.main(["review", str(tmp_path / "m.json")]) == 0
    m = artifact.read(tmp_path / "m.json")
    assert {g.status for g in m.groups} == statuses and m.reviewed is reviewed and (m.reviewed_at is not None) is reviewed


def test_review_by_decisions(spark, tmp_path, capsys):
    proposed(spark, tmp_path)
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "decision": "accept"}, {"id": 2, "decision": "edit", "new_name": "zz_2"}, {"id": 3, "decision": "reject"}]))
    assert cli.main(["review", str(tmp_path / "m.json"), "--decisions", str(tmp_path / "d.json")]) == 0
    m = artifact.read(tmp_path / "m.json")
    assert [g.status for g in m.groups] == ["accepted", "edited", "rejected"] and m.reviewed
    with pytest.raises(ValueError):
        m.decide([(9, "accept", None)])
    with pytest.raises(ValueError):
        m.decide([(1, "edit", " ")])
    assert cli.main(["apply", str(tmp_path / "m.json"), "-o", str(tmp_path / "out.csv"), "--json-log", str(tmp_path / "log.json"), "--csv-log", str(tmp_path / "log.csv")]) == 0
    assert json.loads((tmp_path / "log.json").read_text())["summary"]["rows_changed"] == 4
    assert (tmp_path / "log.csv").read_text().splitlines()[0] == "original,canonical,changed,occurrences,group"
    assert cli.main(["plot", str(tmp_path / "m.json"), "-o", str(tmp_path / "panels.json"), "--title", "t"]) == 0
    panels = json.loads((tmp_path / "panels.json").read_text())
    assert panels["title"] == "t" and len(panels["matrix"]) == 36 and 0 <= panels["colour_floor"] <= 1 and panels["counts"][0]["names"] == 6


def test_propose_and_names(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text(SOURCE)
    assert cli.main(["propose", str(tmp_path / "in.csv"), "-c", "sample_id", "-M", "damerau", "--plot", str(tmp_path / "p.json"), "--yes"]) == 0
    assert (tmp_path / "p.json").exists() and artifact.read(tmp_path / "in_mapping.json").summary()["pending"] == 0
    assert cli.main(["propose", str(tmp_path / "in.csv"), "-c", "sample_id", "-M", "damerau", "-o", str(tmp_path / "in.csv")]) == 1
    assert cli.main(["propose", str(tmp_path / "in.csv"), "-c", "sample_id", "-M", "damerau", "-o", str(tmp_path / "no" / "m.json")]) == 1
    assert (tmp_path / "in.csv").read_text() == SOURCE
    capsys.readouterr()
    for method in ("rules", "damerau"):
        assert cli.main(["names", "sample_1", "Sample-1", "-M", method, "--json"]) == 0
        assert json.loads(capsys.readouterr().out) == [{"canonical": "sample1", "members": ["Sample-1", "sample_1"]}]
    assert cli.main(["names", "sample_1", "sample_2", "-M", "auto"]) == 0  # nothing to mend: no model, no key
    capsys.readouterr()
    assert cli.main(["names", "sample_1", "Sample-1", "-M", "auto"]) == 1
    assert "API key" in capsys.readouterr().err
    (tmp_path / "n.txt").write_bytes(b"\xef\xbb\xbfs_1\n\n s_2 \n")
    assert cli.main(["names", "-f", str(tmp_path / "n.txt")]) == 0 and capsys.readouterr().out == "s1: s_1\ns2: s_2\n".replace("s1:", "sample1:").replace("s2:", "sample2:")
    assert cli.main(["names"]) == 0 and cli.main(["names", "-f", str(tmp_path / "absent")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["names", "a", "--threshold", "1.5"])


def test_notice_when_names_leave_this_machine(monkeypatch, capsys):
    args = lambda *more: cli.parser().parse_args(["propose", "x.csv", "-c", "s", *more])
    for given, host, said in ((("-M", "llm", "-p", "ollama"), None, False), (("-M", "llm", "-p", "ollama"), "otherbox:11434", True), (("-M", "damerau", "-p", "ollama"), "otherbox", False), (("-M", "auto"), None, True)):
        monkeypatch.setenv("OLLAMA_HOST", host) if host else monkeypatch.delenv("OLLAMA_HOST", raising=False)
        cli._proposer(args(*given))
        assert ("not this machine" in capsys.readouterr().err) is said


def test_model_settings(monkeypatch):
    assert model.resolve_model("ollama") == model.DEFAULT_MODELS["ollama"] and model.resolve_url("ollama") == "http://localhost:11434"
    monkeypatch.setenv("OLLAMA_HOST", "box:1/")
    monkeypatch.setenv("OLLAMA_MODEL", "m")
    assert (model.resolve_model("ollama"), model.resolve_model("ollama", "n"), model.resolve_url("ollama"), model.resolve_url("ollama", "https://z/")) == ("m", "n", "http://box:1", "https://z")
    assert model.resolve_url("openrouter").startswith("https://") and model.is_local("http://127.0.0.1:3") and not model.is_local("http://box")


@pytest.mark.parametrize("thinks", [True, False])
def test_a_local_model(spark, thinks):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            if self.path == "/api/show":
                answer = {"capabilities": ["completion"] + ["thinking"] * thinks}
            else:
                names = json.loads(body["messages"][1]["content"])
                answer = {"message": {"content": json.dumps({"canonical_pattern": "p", "mapping": {n: "control1" for n in names if "tr" in n}})}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        proposer = model.http_proposer("ollama", "m", f"http://127.0.0.1:{server.server_port}")
        counts = spark.createDataFrame([("ctrl_1", 1), ("kontrol_1", 2), ("x_2", 1)], "name string, occurrences long")
        assert names_table(counts, "llm", proposer=proposer)[0] == {"canonical": "control1", "members": ["ctrl_1", "kontrol_1"]}
        assert onomast.harmonize(["ctrl_1", "q", "q"], proposer)["mapping"] == {"ctrl_1": "control1", "q": "q"}
    finally:
        server.shutdown()
    assert ("think" in asked[1][1]) is thinks and asked[1][0] == "/api/chat"
    with pytest.raises(ValueError, match="no usable answer"):
        model.http_proposer("ollama", "m", "http://127.0.0.1:9")(["a"])
    assert onomast.harmonize([]) == {"canonical_pattern": "", "mapping": {}}


def test_outputs_are_all_or_none(spark, tmp_path):
    m = proposed(spark, tmp_path)
    m.accept_all()
    (tmp_path / "folder").mkdir()
    for bad in (tmp_path / "folder", tmp_path / "absent" / "log.json", tmp_path / "in.csv"):
        with pytest.raises(ValueError):
            apply_mapping(spark, m, output_path=tmp_path / "out.csv", json_log_path=bad)
        assert not (tmp_path / "out.csv").exists()
    with pytest.raises(ValueError, match="one file"):
        apply_mapping(spark, m, output_path=tmp_path / "out.csv", csv_log_path=tmp_path / "out.csv")
    _, log = harmonize_csv(spark, tmp_path / "in.csv", "sample_id", tmp_path / "out.csv", method="damerau")
    assert (tmp_path / "out.csv").read_text().splitlines()[1] == "S1_B1,sample1_batch1" and log["summary"]["merges"] == 3
    assert {f.name for f in tmp_path.iterdir()} == {"in.csv", "m.json", "folder", "out.csv"}


def test_guards_of_apply(spark, tmp_path):
    m = proposed(spark, tmp_path)
    m.accept_all()
    for change in ({"column": "nope"}, {"canonical_column": "sample_id"}):
        with pytest.raises(ValueError):
            apply_mapping(spark, m, **change)
    (tmp_path / "other.csv").write_text("sample_id\nnothing_9\n")
    with pytest.raises(ValueError, match="no name of the mapping"):
        apply_mapping(spark, m, tmp_path / "other.csv")
    (tmp_path / "joined.csv").write_text("sample_id\nS1_B1\nsample1_batch1\n")
    with pytest.raises(ValueError, match="nobody reviewed"):
        apply_mapping(spark, m, tmp_path / "joined.csv")
    twice = copy.deepcopy(m)
    twice.groups[0].final = twice.groups[1].final
    with pytest.raises(ValueError, match="more than one group"):
        apply_mapping(spark, twice)
    reviewed = copy.deepcopy(m)
    reviewed.mark_reviewed()
    assert apply_mapping(spark, reviewed, tmp_path / "joined.csv")[1]["joined_without_a_decision"] == ["sample1_batch1"]
    lookup = spark.createDataFrame([("S1_B1", "x", 1)], "original string, canonical string, group int")
    assert overlap(spark.createDataFrame([("S1_B1",), ("q",)], "name string"), lookup) == 1


def test_methods_and_thresholds_are_checked(spark):
    counts = spark.createDataFrame([("a", 1)], "name string, occurrences long")
    for method, threshold in (("hamming", 0.85), ("damerau", 1.01), ("damerau", -0.1)):
        with pytest.raises(ValueError):
            propose(counts, method=method, threshold=threshold)
    with pytest.raises(ValueError, match="proposer"):
        propose(counts, method="llm")
    assert propose(counts.limit(0)).groups == []


def test_panels(spark):
    groups = spark.createDataFrame([tuple(artifact.asdict(artifact.Group(i, members, members[0], members[0])).values()) for i, members in enumerate([["a1", "A1", "a_1"], ["b2", "B2"], ["c3"], [f"d{k}" for k in range(9)]], 1)], artifact.GROUP_SCHEMA)
    assert qc.heat_names(groups, 5) == [f"d{k}" for k in range(9)] and qc.heat_names(groups.where("id < 4"), 4) == ["a1", "A1", "a_1", "c3"]
    matrix = qc.similarity_matrix(groups.where("id < 4"))
    cells = {(r["left"], r["right"]): r["similarity"] for r in matrix.collect()}
    assert len(cells) == 36 and cells["a1", "A1"] == 1.0 and cells["a1", "b2"] == 0.0
    assert qc.colour_floor(matrix) == 0.0
