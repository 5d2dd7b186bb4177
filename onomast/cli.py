"""Command line: propose, review, apply, names, plot (panel data as JSON)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from onomast import __version__
from onomast.operators import artifact, cluster, model, qc
from onomast.operators.propose import METHODS, apply_mapping, names_table, propose_csv
from onomast.sources import strict_csv


def _ratio(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is not a number") from None
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"{text} is not between 0 and 1")
    return value


def _session() -> SparkSession:
    return SparkSession.builder.appName("onomast").config("spark.ui.enabled", "false").getOrCreate()


def _proposer(a: argparse.Namespace) -> model.Proposer | None:
    """The model's side of a method, after a notice of what goes where."""
    if a.method in cluster.OFFLINE:
        return None
    what = "every distinct name" if a.method == "llm" else "one spelling of each group, unless the names look consistent,"
    url = model.resolve_url(a.provider, a.base_url)
    if not model.is_local(url):
        print(f"Method {a.method}: {what} goes to {model.resolve_model(a.provider, a.model)} at {url}, which is not this machine.", file=sys.stderr)
    return model.http_proposer(a.provider, a.model, a.base_url, timeout=a.timeout)


def _propose(a: argparse.Namespace) -> None:
    out = Path(a.output or Path(a.file).with_name(Path(a.file).stem + "_mapping.json"))
    if strict_csv.same_file(out, a.file):
        raise ValueError(f"--output is the input, {a.file}")
    if not out.parent.is_dir() or out.is_dir():
        raise ValueError(f"{out} can't be written")
    mapping = propose_csv(_session(), a.file, a.column, a.encoding, method=a.method, threshold=a.threshold, proposer=_proposer(a))
    if mapping.method not in cluster.OFFLINE:
        mapping.model, mapping.provider, mapping.base_url = model.resolve_model(a.provider, a.model), a.provider, model.resolve_url(a.provider, a.base_url)
    if a.yes:
        mapping.accept_all()
    artifact.write(mapping, out)
    if a.plot:
        _write_panels(mapping, a.plot, a.title)
    print(json.dumps(mapping.summary()))
    for left, right in mapping.near_misses[:20]:
        print(f"near miss: {left} | {right}")


def _ask(mapping: artifact.Mapping, g: artifact.Group) -> bool:
    """Put one group to the person until the answer is one; whether to go on."""
    while True:
        match input(f"{g.id}: {', '.join(g.members)} -> {g.proposed} [a/r/e/A/q] ").strip():
            case "q":
                return False
            case "A":
                mapping.accept_all()
                return False
            case "a" | "r" as answer:
                mapping.decide([(g.id, {"a": "accept", "r": "reject"}[answer], None)])
                return True
            case "e":
                while not (name := input("new name: ")).strip():
                    print("A name needs a character that can be seen.")
                mapping.decide([(g.id, "edit", name)])
                return True


def _review(a: argparse.Namespace) -> None:
    if not sys.stdin.isatty() and not a.decisions:
        raise ValueError("review needs a terminal, or --decisions")
    mapping = artifact.read(a.mapping)
    if a.decisions:
        mapping.decide([(int(d["id"]), d["decision"], d.get("new_name")) for d in json.loads(Path(a.decisions).read_text())])
    else:
        for g in mapping.review_order():
            if g.status == "proposed" and not _ask(mapping, g):
                break
        mapping.mark_reviewed()
    artifact.write(mapping, a.mapping)


def _apply(a: argparse.Namespace) -> None:
    mapping = artifact.read(a.mapping)
    _, log = apply_mapping(_session(), mapping, a.data, a.column, a.output, a.canonical_column, a.json_log, a.csv_log, a.mapping, a.encoding)
    print(json.dumps(log["summary"]))


def _names(a: argparse.Namespace) -> None:
    names = strict_csv.read_names(a.names, a.file)
    once = _session().createDataFrame([(n, 1) for n in dict.fromkeys(names)], "name string, occurrences long")
    rows = names_table(once, a.method, a.threshold, _proposer(a)) if names else []
    print(json.dumps(rows, ensure_ascii=False, indent=2) if a.json else "\n".join(f"{r['canonical']}: {', '.join(r['members'])}" for r in rows))


def _write_panels(mapping: artifact.Mapping, path: str, title: str | None) -> None:
    spark = _session()
    groups = artifact.groups_frame(spark, mapping)
    near = spark.createDataFrame([tuple(p) for p in mapping.near_misses], "left string, right string")
    panels = {"matrix": qc.similarity_matrix(groups), "sizes": qc.group_sizes(groups), "counts": qc.before_after(groups, near), "flags": qc.flags(groups, near)}
    shown = {k: [r.asDict() for r in v.collect()] for k, v in panels.items()}
    shown["colour_floor"] = qc.colour_floor(panels["matrix"])
    with artifact.replacing(path) as beside:
        beside.write_text(json.dumps({"title": title or mapping.column or ""} | shown, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def _plot(a: argparse.Namespace) -> None:
    _write_panels(artifact.read(a.mapping), a.output, a.title)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="onomast")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(required=True)
    model_options = argparse.ArgumentParser(add_help=False)
    model_options.add_argument("--threshold", type=_ratio, default=0.85)
    model_options.add_argument("-m", "--model")
    model_options.add_argument("-p", "--provider", default="openrouter", choices=sorted(model.DEFAULT_MODELS))
    model_options.add_argument("--base-url")
    model_options.add_argument("--timeout", type=float)
    p = sub.add_parser("propose", parents=[model_options])
    p.add_argument("file")
    p.add_argument("-c", "--column", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("-M", "--method", default="auto", choices=METHODS)
    p.add_argument("--yes", action="store_true")
    p.add_argument("--plot", help="also write the data of the panels to this JSON file")
    p.add_argument("--title")
    p.add_argument("--encoding", default=artifact.DEFAULT_ENCODING)
    p.set_defaults(run=_propose)
    r = sub.add_parser("review")
    r.add_argument("mapping")
    r.add_argument("--decisions", help="JSON list of {id, decision, new_name}")
    r.set_defaults(run=_review)
    a = sub.add_parser("apply")
    a.add_argument("mapping")
    for flag in ("--data", "--canonical-column", "--encoding", "--json-log", "--csv-log"):
        a.add_argument(flag)
    a.add_argument("-c", "--column")
    a.add_argument("-o", "--output")
    a.set_defaults(run=_apply)
    n = sub.add_parser("names", parents=[model_options])
    n.add_argument("names", nargs="*")
    n.add_argument("-f", "--file")
    n.add_argument("-M", "--method", default="damerau", choices=METHODS)
    n.add_argument("--json", action="store_true")
    n.set_defaults(run=_names)
    q = sub.add_parser("plot")
    q.add_argument("mapping")
    q.add_argument("-o", "--output", required=True)
    q.add_argument("--title")
    q.set_defaults(run=_plot)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
