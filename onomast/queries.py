"""Registered queries of the identifier engine over the driver's tables, each with its DuckDB equivalent.

The tables hold no messy names, so ``NOISY`` writes the customers' keys in eight ways, one fault each.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions import distance as D
from onomast.functions import names as N
from onomast.operators import apply, artifact, canonical, cluster, model, nearmiss, qc
from onomast.operators import profile as prof
from onomast.operators.propose import apply_mapping, harmonize_csv, propose_csv, propose_groups
from onomast.plans.shared import materialize, scratch_path
from onomast.sources import strict_csv

NOISY = """
with k as (select c_custkey, cast(floor(c_custkey / 8) as bigint) as n, c_custkey % 8 as v from customer),
     s as (select c_custkey as row_id, v, cast(n as string) as n, cast(n % 3 + 1 as string) as b from k)
select row_id, v, n, b, case v
  when 0 then concat('patient', n, '_batch', b) when 1 then concat('P', n, '_B', b)
  when 2 then concat('p', lpad(n, 4, '0'), '-b0', b) when 3 then concat('patietn', n, '_batch', b)
  when 4 then concat('patint', n, '_batch', b) when 5 then concat('PATIENT', n, '.BATCH', b)
  when 6 then concat('pt', n, ' bat', b) else concat('batient', n, '_batch', b) end as raw_name
from s"""

#: Names of three words with a sign, from the parts' keys: twelve spellings, some with a slip in one of the words.
VARIED = """
with k as (select p_partkey, cast(floor(p_partkey / 12) as bigint) as n, p_partkey % 12 as v from part),
     s as (select p_partkey as row_id, v, cast(n as string) as n, cast(n % 4 + 1 as string) as b, case when n % 2 = 0 then '+' else '-' end as sign from k)
select row_id, n, v, case v
  when 0 then concat('donor', n, '_cell', sign, '_plate', b) when 1 then concat('Donor-', n, ' CELL', sign, ' plate-0', b)
  when 2 then concat('donro', n, '_cell', sign, '_plate', b) when 3 then concat('donor', n, '_cell', sign, '_palte', b)
  when 4 then concat('donor', n, '_celll', sign, '_plate', b) when 5 then concat('donor', n, '_cell', sign, '_plates', b)
  when 6 then concat('donor', n, '_cell_plate', b) when 7 then concat('honor', n, '_cell', sign, '_plate', b)
  when 8 then concat('donor', n, '_cells', sign, '_palte', b) when 9 then concat('plate', b, '_donor', n, '_cell', sign)
  when 10 then concat('donor', n, '_s', b) else concat('donor', n, '_sample', b) end as raw_name
from s"""

#: Names of several tables, one column.
NAMES = {"customer": "c_name", "supplier": "s_name", "nation": "n_name", "part": "p_brand", "pages": "url"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def noisy(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(NOISY.replace("from customer", "from {customer}"), customer=_table(spark, d, "customer"))


def varied(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(VARIED.replace("from part", "from {part}"), part=_table(spark, d, "part"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    out = noisy(spark, d).select(F.col("raw_name").alias("name")).union(varied(spark, d).select("raw_name"))
    for table, column in NAMES.items():
        out = out.union(_table(spark, d, table).select(column))
    return out.where("name is not null").distinct()


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return prof.name_counts(noisy(spark, d), "raw_name")


def _as_written(spark: SparkSession, d: str, found: DataFrame, how: str = "inner") -> DataFrame:
    """``found`` of distinct names, for each row of the noisy names: from 10,000 on, padding to four digits cuts numbers, so names repeat."""
    return noisy(spark, d).select(F.col("raw_name").alias("name")).join(found, "name", how)


def name_prepare(spark, d):
    return _names(spark, d).select("name", N.prepare(F.col("name")).alias("prepared"))


def name_tokens(spark, d):
    return _names(spark, d).select("name", F.array_join(N.tokens(F.col("name")), "|").alias("tokens"), F.array_join(N.letter_tokens(F.col("name")), "|").alias("letters"))


def name_skeleton(spark, d):
    return _names(spark, d).select("name", N.skeleton(F.col("name")).alias("skeleton"), N.is_canonical(F.col("name")).alias("canonical"), N.shorten(F.col("name")).alias("label"))


def name_normalise(spark, d):
    return _names(spark, d).select("name", N.normalise(F.col("name")).alias("norm"))


def name_signature(spark, d):
    return _names(spark, d).select("name", F.array_join(N.signature(F.col("name")), "|").alias("signature"))


def name_deletions(spark, d):
    rows = _table(spark, d, "part").select("p_brand").distinct()
    return rows.select("p_brand", F.explode(N.deletions(F.col("p_brand"))).alias("deletion"))


def _pairs(spark, d):
    rows = noisy(spark, d).select("n", "v", F.col("raw_name").alias("name")).withColumns(N.features(F.col("name")))
    feature = F.struct("signature", "norm", "skeleton", "letters")
    left = rows.select("n", F.col("v").alias("va"), F.col("name").alias("a"), feature.alias("fa"))
    right = rows.select("n", F.col("v").alias("vb"), F.col("name").alias("b"), feature.alias("fb"))
    return left.join(right, "n").where("va < vb")


def distance_pairs(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select(
        "a", "b", D.hamming(a, b).cast("long").alias("hamming"), D.levenshtein(a, b).cast("long").alias("levenshtein"), D.within_one(a, b).alias("osa_le_1"),
        F.round(D.similarity(a, b, "levenshtein"), 6).alias("similarity"), F.round(D.similarity(a, b, "hamming"), 6).alias("similarity_hamming"),
    )


def osa_distance(spark, d):
    """The full alignment distance of the letters."""
    return _pairs(spark, d).select("a", "b", D.osa()(F.col("fa.skeleton"), F.col("fb.skeleton")).alias("osa"))


def difference_label(spark, d):
    return _pairs(spark, d).select("a", "b", D.describe(F.col("fa"), F.col("fb"), F.col("a"), F.col("b")).alias("difference"))


def _varied_pairs(spark, d):
    rows = varied(spark, d).select("n", "v", F.col("raw_name").alias("name")).withColumns(N.features(F.col("name")))
    feature = F.struct("signature", "norm", "skeleton", "letters")
    left, right = (rows.select("n", F.col("v").alias(f"v{x}"), F.col("name").alias(x), feature.alias(f"f{x}")) for x in "ab")
    return left.join(right, "n").where("va < vb")


def match_varied(spark, d):
    a, b = F.col("fa"), F.col("fb")
    rules = {f"by_{m}": D.matches(a, b, m, 0.85) for m in ("rules", "damerau")}
    return _varied_pairs(spark, d).where("fa.signature = fb.signature").select("a", "b", *(c.alias(k) for k, c in rules.items()), D.token_substituted(a, b).alias("token_substituted"), D.comparable(a, b)["l"].alias("l"), D.comparable(a, b)["r"].alias("r"))


def match_predicate(spark, d):
    return _pairs(spark, d).select("a", "b", D.matches(F.col("fa"), F.col("fb"), "rules", 0.85).alias("by_rules"), D.matches(F.col("fa"), F.col("fb"), "damerau", 0.85).alias("by_damerau"))


def name_counts(spark, d):
    return prof.name_counts(_table(spark, d, "orders"), "o_orderpriority").union(prof.name_counts(_table(spark, d, "events"), "event_type"))


def skeleton_corpus(spark, d):
    return canonical.skeleton_corpus(_counts(spark, d))


def name_profile(spark, d):
    row = prof.profile(_counts(spark, d).select("name"))
    return row.withColumn("abbreviations_detected", F.array_join("abbreviations_detected", "|"))


def group_rules(spark, d):
    return _as_written(spark, d, cluster.group_names(_counts(spark, d).select("name"), "rules").select("name", "group"), "left")


def group_damerau(spark, d):
    return cluster.group_names(_counts(spark, d).select("name"), "damerau").select("name", "group")


def _varied_counts(spark, d) -> DataFrame:
    return prof.name_counts(varied(spark, d), "raw_name")


def group_varied(spark, d):
    return cluster.group_names(_varied_counts(spark, d).select("name"), "damerau").select("name", "group")


def group_table_varied(spark, d):
    return _flat(propose_groups(_varied_counts(spark, d), "damerau"))


def letter_variants_varied(spark, d):
    return nearmiss.find_letter_variants(cluster.with_features(_varied_counts(spark, d).select("name")))


def canonical_names(spark, d):
    counts = materialize(_counts(spark, d), "counts")
    grouped = cluster.group_names(counts.select("name"), "damerau")
    return canonical.elect(grouped, counts, canonical.skeleton_corpus(counts))


def _flat(table: DataFrame) -> DataFrame:
    rows = F.aggregate(F.map_values("occurrences"), F.lit(0).cast("long"), lambda a, x: a + x)
    return table.select("id", F.array_join("members", "|").alias("members"), "proposed", "final", "status", rows.alias("rows"), "method", "min_similarity")


def group_table(spark, d):
    return _flat(propose_groups(_counts(spark, d), "damerau"))


def near_misses(spark, d):
    """Customers numbered in steps of eleven: no number has a neighbour, so every lost digit is reported."""
    sparse = _table(spark, d, "customer").select(F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") * 11).cast("string"), 12, "0")).alias("name"))
    return nearmiss.find_near_misses(cluster.with_features(sparse))


def near_misses_dense(spark, d):
    """Numbers that end in 0, 1 or 5: of a pair of two numbers with neighbours nothing is reported, of others it is."""
    some = _table(spark, d, "customer").where("c_custkey % 10 in (0, 1, 5)").select(F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("name"))
    return nearmiss.find_near_misses(cluster.with_features(some))


def letter_variants(spark, d):
    return nearmiss.find_letter_variants(cluster.with_features(_counts(spark, d).select("name")))


def _lookup(spark, d) -> DataFrame:
    """A decided mapping: all spellings but the last to the reference spelling; two spellings of a third of the names undecided."""
    rows = noisy(spark, d).where("v <> 7 and not (b = '2' and v in (0, 5))")
    return rows.select(F.col("raw_name").alias("original"), F.concat(F.lit("patient"), "n", F.lit("_batch"), "b").alias("canonical"), (F.col("n").cast("int") + 1).alias("group"))


def _facts(spark, d) -> DataFrame:
    names = noisy(spark, d).select("row_id", "raw_name")
    return _table(spark, d, "orders").select("o_orderkey", "o_custkey").join(names, F.col("o_custkey") == F.col("row_id")).select("o_orderkey", "raw_name")


def apply_lookup(spark, d):
    return apply.apply_lookup(_facts(spark, d), "raw_name", _lookup(spark, d))


def change_log(spark, d):
    return apply.change_log(prof.name_counts(_facts(spark, d), "raw_name"), _lookup(spark, d))


def joined_without_decision(spark, d):
    return apply.joined_without_decision(prof.name_counts(_facts(spark, d), "raw_name"), _lookup(spark, d))


def change_summary(spark, d):
    changes = change_log(spark, d)
    return apply.change_summary(apply_lookup(spark, d), "raw_name", "raw_name_canonical", changes)


def _decided(spark, d) -> DataFrame:
    """A group for each spelling, a fifth rejected: many groups produce one name."""
    row = noisy(spark, d)
    status = F.when(F.col("row_id") % 5 == 0, "rejected").otherwise("accepted")
    final = F.concat(F.lit("patient"), "n", F.lit("_batch"), "b")
    return row.select(F.col("row_id").cast("int").alias("id"), F.array("raw_name").alias("members"), final.alias("proposed"), final.alias("final"), status.alias("status"), F.create_map("raw_name", F.lit(1).cast("long")).alias("occurrences"))


def collisions(spark, d):
    return artifact.collisions_frame(_decided(spark, d)).select("name", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"))


def resolved_mapping(spark, d):
    return artifact.lookup_of(_decided(spark, d))


def _proposed(spark, d) -> tuple[DataFrame, DataFrame]:
    counts = _counts(spark, d)
    table = materialize(propose_groups(counts, "damerau"), "proposed")
    return table, nearmiss.find_letter_variants(cluster.with_features(counts.select("name")))


def qc_sizes(spark, d):
    return qc.group_sizes(_proposed(spark, d)[0])


def qc_counts(spark, d):
    return qc.before_after(*_proposed(spark, d))


def qc_flags(spark, d):
    """A report of nine rows, which is the feature."""
    return qc.flags(*_proposed(spark, d))


def qc_matrix(spark, d):
    """A panel of at most 40 names, which is the feature: of the largest groups of the varied names."""
    table = propose_groups(_varied_counts(spark, d), "damerau")
    return qc.similarity_matrix(materialize(table, "proposed")).select("left", "right", F.round("similarity", 6).alias("similarity"))


def model_guard(spark, d):
    """A model that answers one name for all names of a batch: numbers keep them apart."""
    counts = materialize(_counts(spark, d), "counts")
    rows = noisy(spark, d)
    answer = rows.select(F.col("raw_name").alias("name"), F.concat(F.lit("patient1_batch"), "b").alias("canonical"))
    featured = cluster.with_features(counts.select("name")).select("name", *cluster.FEATURES)
    return _as_written(spark, d, model.guard(featured, answer).select("name", "group", "proposed"))


def _written_csv(spark, d) -> str:
    """The noisy names as a CSV file of the shared folder, which has to be one that ``open`` reaches."""
    folder = scratch_path(spark, "csv")
    if not folder.startswith(("file:", "/")):
        raise ValueError(f"{folder}: CSV files are read from mounted folders only")
    path = Path(folder.removeprefix("file://").removeprefix("file:"))
    path.mkdir(parents=True)
    with open(path / "names.csv", "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(["row_id", "name", "note, with a comma"])
        out.writerows((r["row_id"], r["raw_name"], f'v "{r["v"]}"\n') for r in noisy(spark, d).toLocalIterator())
    return str(path / "names.csv")


def csv_harmonize(spark, d):
    """CSV in, proposal, acceptance of all, CSV out, read again: every row, in place and unchanged, with its new name."""
    source = _written_csv(spark, d)
    target = source.replace("names.csv", "out.csv")
    harmonize_csv(spark, source, "name", target, method="damerau")
    out = strict_csv.read_table(spark, target, "name_canonical")
    return out.frame.select(F.col("__row").alias("place"), F.col("c0").cast("long").alias("row_id"), F.col("c1").alias("name"), F.col("c2").alias("note"), F.col("c3").alias("name_canonical"))


def csv_changes(spark, d):
    """The change log of an applied document."""
    mapping = propose_csv(spark, _written_csv(spark, d), "name", method="damerau")
    mapping.accept_all()
    rows = [(r["original"], r["canonical"], r["changed"], r["occurrences"], r["group"]) for r in apply_mapping(spark, mapping)[1]["changes"]]
    return spark.createDataFrame(rows, 'original string, canonical string, changed boolean, occurrences long, "group" int'.replace('"group"', "group"))


def mapping_document(spark, d):
    """A proposal decided by its numbers (every third rejected, every fifth edited), written and read again."""
    source = _written_csv(spark, d)
    mapping = propose_csv(spark, source, "name", method="damerau")
    mapping.decide([(g.id, "reject", None) if g.id % 3 == 0 else (g.id, "edit", f"edited_{g.id}") if g.id % 5 == 0 else (g.id, "accept", None) for g in mapping.review_order()])
    path = source.replace("names.csv", "mapping.json")
    artifact.write(mapping, path)
    again = artifact.read(path)
    reviewed = F.lit(again.reviewed and not again.pending())
    return _flat(artifact.groups_frame(spark, again)).withColumn("reviewed", reviewed)


ALL = (
    name_prepare, name_tokens, name_skeleton, name_normalise, name_signature, name_deletions, distance_pairs, osa_distance, difference_label, match_predicate, match_varied,
    name_counts, skeleton_corpus, name_profile, group_rules, group_damerau, canonical_names, group_table, group_varied, group_table_varied, letter_variants_varied, near_misses, near_misses_dense, letter_variants,
    apply_lookup, change_log, joined_without_decision, change_summary, collisions, resolved_mapping, qc_sizes, qc_counts, qc_flags, qc_matrix, model_guard,
    csv_harmonize, csv_changes, mapping_document,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


# ---- DuckDB ----------------------------------------------------------------------------------------------------------------

_NOISY = f"noisy as ({NOISY.strip()})"
_VARIED = f"varied as ({VARIED.strip()})"
_NAMES = f"{_NOISY}, {_VARIED}, names as (select distinct name from ({' union all '.join(['select raw_name as name from noisy', 'select raw_name from varied', *(f'select {c} from {t}' for t, c in NAMES.items())])}) where name is not null)"


def _prep(x: str) -> str:
    once = r"regexp_replace({}, '([a-z0-9])-([a-z0-9])', '\1_\2', 'g')"
    return once.format(once.format(f"lower({x})"))


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({_prep(x)}, '[_.\s]'), lambda t: t <> '')"


def _unpad(x: str) -> str:
    return rf"regexp_replace({x}, '^0+([0-9])', '\1')"


def _letters(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z]', '', 'g')"


def _expand(t: str) -> str:
    """A token's canonical term with its number unpadded."""
    number = _unpad(f"regexp_extract({t}, '[0-9]+')")
    numbered = {"sample": "samp[0-9]*|s[0-9]+", "patient": "pt[0-9]*|p[0-9]+", "batch": "bat[0-9]*|b[0-9]+", "replicate": "rep[0-9]*|r[0-9]+", "timepoint": "tp[0-9]*"}
    plain = {"control": "ctrl|ctl", "treatment": "trt", "wildtype": "wt", "knockout": "ko"}
    cases = " ".join([*(f"when regexp_full_match({t}, '{p}') then concat('{c}', {number})" for c, p in numbered.items()), *(f"when regexp_full_match({t}, '{p}') then '{c}'" for c, p in plain.items())])
    return f"case {cases} when regexp_full_match({t}, '[0-9]+') then {_unpad(t)} when regexp_full_match({t}, '[a-z]+[0-9]+[a-z]*') then regexp_replace({t}, '^([a-z]+)0+([0-9])', '\\1\\2') else {t} end"


def _norm(x: str) -> str:
    joined = rf"regexp_replace(array_to_string({_tokens(x)}, '_'), '([^0-9_])_([0-9]+)(_|$)', '\1\2\3', 'g')"
    return f"regexp_replace(array_to_string(list_filter(list_transform(string_split({joined}, '_'), lambda t: {_expand('t')}), lambda t: t <> ''), '_'), '[^a-z0-9_+''-]', '', 'g')"


def _sig_list(x: str) -> str:
    """Numbers with their suffixes in order, then each sign with the numbers before it and the word it touches."""
    cut = r"regexp_replace({}, '([0-9])[a-z]+([0-9])', '\1_\2', 'g')"
    numbers = f"list_transform(regexp_extract_all({cut.format(cut.format(_prep(x)))}, '[0-9]+[a-z]*'), lambda t: {_unpad('t')})"
    pieces = f"regexp_extract_all({_prep(x)}, '[0-9]+|[a-z]*[+''-]')"
    before = "len(list_filter(ps[1:i - 1], lambda q: q[1] between '0' and '9'))"
    signs = f"list_filter(list_transform(range(1, len(ps) + 1), lambda i: case when ps[i][1] between '0' and '9' then '' else concat({before}, {_expand('ps[i][1:length(ps[i]) - 1]')}, ps[i][-1]) end), lambda t: t <> '')"
    return f"list_concat({numbers}, list_transform([{pieces}], lambda ps: {signs})[1])"


def _sig(x: str) -> str:
    return f"array_to_string({_sig_list(x)}, '|')"


def _classify(a: str, b: str) -> str:
    return (
        f"case when {a} = {b} or damerau_levenshtein({a}, {b}) <> 1 then 'unrelated' when length({a}) <> length({b}) then 'insertion or deletion' "
        f"when levenshtein({a}, {b}) = 2 then 'transposition' else 'substitution' end"
    )


def _features(names: str) -> str:
    """CTE f: name, s, m, k, w (signature, normal form, skeleton, letter tokens) of the names of a subquery."""
    letters = f"list_filter(list_transform({_tokens('name')}, lambda t: {_letters('t')}), lambda t: t <> '')"
    return f"f as (select name, {_sig('name')} as s, {_norm('name')} as m, {_letters('lower(name)')} as k, {letters} as w from ({names}))"


#: CTE osa: the alignment distance of each pair (l, r) of the CTE todo, row by row of its grid. A cell's left neighbour is taken care of
#: by the least, over the cells to its left, of their value without it plus the way from there.
_OSA = """grid as (
    select l, r, 0 as i, cast(null as bigint[]) as two, range(0, length(r) + 1) as one from (select distinct l, r from todo)
    union all select l, r, i + 1, one, list_transform(range(0, len(t)), lambda j: list_min(list_transform(range(0, j + 1), lambda p: t[p + 1] + j - p))) from (
        select *, list_transform(range(0, length(r) + 1), lambda j: case when j = 0 then i + 1 else least(one[j + 1] + 1, one[j] + case when l[i + 1] = r[j] then 0 else 1 end,
            case when i > 0 and j > 1 and l[i + 1] = r[j - 1] and l[i] = r[j] then two[j - 1] + 1 else 1000000 end) end) as t from grid where i < length(l))),
    osa as (select l, r, one[length(r) + 1] as osa from grid where i = length(l))"""

#: CTE pairs: names x, y of one signature, with what of them is compared (l, r) and the verdicts of the rules in their order.
_VERDICTS = """cells as (select x.name as a, y.name as b, x.s, x.m as ma, y.m as mb, x.k as ka, y.k as kb, x.w as wa, y.w as wb, list_filter(range(1, len(x.w) + 1), lambda i: x.w[i] <> y.w[i]) as apart from f x join f y on x.s = y.s and x.name <> y.name),
    compared as (select *, case when len(wa) = len(wb) and len(apart) = 1 then wa[apart[1]] else ka end as l, case when len(wa) = len(wb) and len(apart) = 1 then wb[apart[1]] else kb end as r,
        len(wa) <> len(wb) and regexp_full_match(concat('|', array_to_string(case when len(wa) > len(wb) then wa else wb end, '|'), '|'), concat('.*[|]', array_to_string(case when len(wa) > len(wb) then wb else wa end, '[|](.*[|])?'), '[|].*')) as gained,
        len(wa) = len(wb) and len(wa) >= 2 and len(list_filter(apart, lambda i: length(wa[i]) = length(wb[i]) and levenshtein(wa[i], wb[i]) = 1)) > 0 as token_substituted from cells),
    todo as (select l, r from compared),
    judged as (select compared.*, osa, case when gained then false else ma <> '' and ma = mb end as by_rules,
        case when gained then false when ma <> '' and ma = mb then true when l = '' or r = '' then false when l <> r and (starts_with(l, r) or starts_with(r, l) or ends_with(l, r) or ends_with(r, l)) then false
            when l <> r and (osa <> 1 or length(l) = length(r) and levenshtein(l, r) = 1) then false when l <> r and least(length(l), length(r)) >= 5 then true
            else l = r or 1 - 1 / greatest(length(l), length(r)) >= 0.85 end as by_damerau from compared join osa using (l, r))"""

#: CTE grouped: transitive closure of the links, split by skeleton where two members differ by a substituted letter.
_CLOSURE = """reach as (select name as v, name as o from f union select reach.v, b from reach join judged on reach.o = a where by_damerau),
    parts as (select v as name, min(o) as c from reach group by 1),
    torn as (select distinct p.c from parts p join parts q on p.c = q.c join judged on p.name = a and q.name = b
        where length(ka) = length(kb) and hamming(case when ka = '' then '.' else ka end, case when kb = '' then '.' else kb end) = 1 and not (ma = mb and ma <> '') or token_substituted),
    grouped as (select name, min(name) over (partition by parts.c, case when torn.c is null then '' else k end) as "group", s, m, k, w from parts join f using (name) left join torn on torn.c = parts.c)"""

#: CTE elected: the weighted medoid of the forms of each group. Names are distinct, so each weighs what it occurs.
_ELECTION = """forms as (select "group", case when m <> '' then m else name end as form, sum(occurrences) as weight from grouped join counts using (name) group by 1, 2),
    corpus as (select k, sum(occurrences) as agreement from f join counts using (name) group by 1),
    todo as (select x.form as l, y.form as r from forms x join forms y using ("group") union select x.k, y.k from grouped x join grouped y using ("group")), OSA,
    costs as (select x."group", x.form, x.weight, sum(y.weight * osa) as cost from forms x join forms y using ("group") join osa on l = x.form and r = y.form group by 1, 2, 3),
    elected as (select "group", form as proposed from costs left join corpus on k = LETTERS qualify row_number() over (partition by "group" order by cost, coalesce(agreement, 0) desc, weight desc, length(form) desc, form) = 1)""".replace("LETTERS", _letters("lower(form)")).replace("OSA", _OSA.replace("grid", "grid2"))


def _grouped(names: str, election: bool = False) -> str:
    """The CTEs up to the groups of the names of a subquery, by the rules and not by how the names were made."""
    made = f"with recursive {_NOISY}, {_VARIED}, {_features(f'select distinct raw_name as name from {names}')}, {_VERDICTS.replace('judged as', f'{_OSA}, judged as')}, {_CLOSURE}"
    if not election:
        return made
    # The second election of distances has tables of its own.
    later = _ELECTION.replace("todo", "todo2").replace(" osa as", " osa2 as").replace("join osa on", "join osa2 on")
    return f"{made}, counts as (select raw_name as name, count(*) as occurrences from {names} group by 1), {later}"


def _group_table(names: str) -> str:
    return _grouped(names, True) + """, likeness as (select x."group", min(1 - osa / greatest(length(l), length(r))) as low from grouped x join grouped y on x."group" = y."group" and x.k <> y.k join osa2 on l = x.k and r = y.k group by 1),
        g as (select "group", string_agg(name, '|' order by name) as members, count(*) as k, cast(sum(occurrences) as bigint) as rows from grouped join counts using (name) group by 1)
        select cast(row_number() over (order by g."group") as int) as id, members, proposed, proposed as final, 'proposed' as status, rows, 'damerau' as method, case when g.k > 1 then round_even(coalesce(low, 1.0), 4) end as min_similarity from g join elected using ("group") left join likeness using ("group")"""


_PAIRS = f"with {_NOISY}, pairs as (select x.n, x.v as va, y.v as vb, x.raw_name as a, y.raw_name as b from noisy x join noisy y on x.n = y.n and x.v < y.v)"
_GROUPS = "grouped as (select raw_name as name, case when v = 7 then raw_name else min(case when v <> 7 then raw_name end) over (partition by n) end as \"group\", n, b, v from noisy)"
_LOOKUP = "lookup as (select raw_name as original, concat('patient', n, '_batch', b) as canonical, cast(n as int) + 1 as \"group\" from noisy where v <> 7 and not (b = '2' and v in (0, 5)))"
_FACTS = "facts as (select o_orderkey, raw_name from orders join noisy on o_custkey = row_id)"
_DECIDED = "decided as (select cast(row_id as int) as id, raw_name, concat('patient', n, '_batch', b) as final, case when row_id % 5 = 0 then 'rejected' else 'accepted' end as status from noisy)"
_APPLIED = "applied as (select o_orderkey, raw_name, coalesce(canonical, raw_name) as raw_name_canonical from facts left join lookup on raw_name = original)"
_CHANGES = "changes as (select original, canonical, original <> canonical as changed, cast(coalesce(k, 0) as bigint) as occurrences, \"group\" from lookup left join (select raw_name, count(*) as k from facts group by raw_name) on raw_name = original)"


def oracle_sql() -> dict[str, str]:
    skeleton = lambda x: _letters(f"lower({x})")
    return {
        "name_prepare": f"with {_NAMES} select name, {_prep('name')} as prepared from names",
        "name_tokens": f"with {_NAMES} select name, array_to_string({_tokens('name')}, '|') as tokens, array_to_string(list_filter(list_transform({_tokens('name')}, lambda t: {_letters('t')}), lambda t: t <> ''), '|') as letters from names",
        "name_skeleton": f"with {_NAMES} select name, {skeleton('name')} as skeleton, regexp_full_match(name, '[a-z0-9_]+') and regexp_matches(name, '[^_]') as canonical, case when length(name) <= 26 then name else concat(left(name, 12), '…', right(name, 12)) end as label from names",
        "name_normalise": f"with {_NAMES} select name, {_norm('name')} as norm from names",
        "name_signature": f"with {_NAMES} select name, {_sig('name')} as signature from names",
        "name_deletions": "select distinct p_brand, concat(substr(p_brand, 1, i - 1), substr(p_brand, i + 1)) as deletion from (select p_brand, unnest(range(1, length(p_brand) + 1)) as i from (select distinct p_brand from part))",
        "distance_pairs": _PAIRS + " select a, b, case when length(a) = length(b) then cast(hamming(a, b) as bigint) end as hamming, cast(levenshtein(a, b) as bigint) as levenshtein, damerau_levenshtein(a, b) <= 1 as osa_le_1, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as similarity, round(case when length(a) = length(b) then 1 - hamming(a, b) / length(a) else 0.0 end, 6) as similarity_hamming from pairs",
        "difference_label": _PAIRS + f" select a, b, case when {_sig('a')} <> {_sig('b')} then 'different identifiers' when {_norm('a')} = {_norm('b')} or {skeleton('a')} = {skeleton('b')} then 'formatting only' else {_classify(skeleton('a'), skeleton('b'))} end as difference from pairs",
        "match_predicate": _grouped("noisy") + " select a, b, by_rules, by_damerau from (select x.raw_name as a, y.raw_name as b from noisy x join noisy y on x.n = y.n and x.v < y.v) left join judged using (a, b) where by_rules is not null union all select x.raw_name, y.raw_name, false, false from noisy x join noisy y on x.n = y.n and x.v < y.v where (x.raw_name, y.raw_name) not in (select (a, b) from judged)",
        "name_counts": "select o_orderpriority as name, count(*) as occurrences from orders where trim(o_orderpriority) <> '' group by 1 union all select event_type, count(*) from events where trim(event_type) <> '' group by 1",
        "skeleton_corpus": f"with {_NOISY} select {skeleton('raw_name')} as skeleton, cast(count(*) as bigint) as weight from noisy group by 1",
        "name_profile": f"""with {_NOISY}, t as (select unnest({_tokens('raw_name')}) as t from noisy), d as (select unnest(regexp_extract_all(raw_name, '[0-9]+')) as d from noisy),
            z as (select regexp_replace(d, '^0+(.)', '\\1') as x, bool_or(regexp_matches(d, '^0.')) as p, bool_or(not regexp_matches(d, '^0.')) as u from d group by 1),
            l as (select * from (values (0, 'sample (samp<n>)', 'samp[0-9]*'), (1, 'sample (s<n>)', 's[0-9]+'), (2, 'patient (pt<n>)', 'pt[0-9]*'), (3, 'patient (p<n>)', 'p[0-9]+'), (4, 'batch (bat<n>)', 'bat[0-9]*'), (5, 'batch (b<n>)', 'b[0-9]+'), (6, 'replicate (rep<n>)', 'rep[0-9]*'), (7, 'replicate (r<n>)', 'r[0-9]+')) as l(o, label, pattern)),
            f as (select string_agg(label, '|' order by o) as labels from l where exists (select 1 from t where regexp_full_match(t, pattern)))
            select (max(cast(contains(raw_name, '_') as int)) + max(cast(contains(raw_name, '-') as int)) + max(cast(contains(raw_name, '.') as int))) > 1 as delimiter_mix, max(f.labels) as abbreviations_detected, (select bool_or(p and u) from z) as zero_padding,
            bool_or(regexp_matches(raw_name, '[A-Z]')) and bool_or(regexp_matches(raw_name, '[a-z]')) as case_mix, 'inconsistencies_found' as verdict from noisy, f""",
        "group_rules": f"with {_NOISY}, f as (select raw_name as name, {_sig('raw_name')} as s, {_norm('raw_name')} as m from noisy) select name, min(name) over (partition by s, m) as \"group\" from f",
        "group_damerau": _grouped("noisy") + ' select name, "group" from grouped',
        "canonical_names": _grouped("noisy", True) + ' select "group", proposed from elected',
        "group_table": _group_table("noisy"),
        "osa_distance": _PAIRS.replace("with ", "with recursive ", 1) + f", todo as (select {skeleton('a')} as l, {skeleton('b')} as r from pairs), {_OSA} select a, b, osa from pairs join osa on l = {skeleton('a')} and r = {skeleton('b')}",
        "match_varied": _grouped("varied") + " select a, b, by_rules, by_damerau, token_substituted, l, r from (select x.raw_name as a, y.raw_name as b from varied x join varied y on x.n = y.n and x.v < y.v) join judged using (a, b)",
        "group_varied": _grouped("varied") + ' select name, "group" from grouped',
        "group_table_varied": _group_table("varied"),
        "letter_variants_varied": f"with {_VARIED}, {_features('select distinct raw_name as name from varied')}, c as (select name, s, k, unnest(range(1, length(k) + 1)) as i from f), g as (select name, concat(s, '/', i, '/', substr(k, 1, i - 1), '|', substr(k, i + 1)) as gap, k[i] as letter from c), two as (select gap from g group by 1 having count(distinct letter) = 2) select distinct least(x.name, y.name) as \"left\", greatest(x.name, y.name) as \"right\" from g x join g y using (gap) join two using (gap) where x.letter <> y.letter",
        "qc_matrix": _grouped("varied") + """, sizes as (select "group", count(*) as n, min(name) as first, list(name order by name) as members from grouped group by 1),
            ranked as (select members, n, row_number() over (order by n desc, first) as o from sizes), taken as (select o, n, members, n as total from ranked where o = 1 union all select r.o, r.n, r.members, t.total + case when t.total + r.n <= 40 then r.n else 0 end from taken t join ranked r on r.o = t.o + 1 where t.total < 40),
            shown as (select t.o, unnest(members) as name from taken t left join (select o + 1 as o, total from taken) p using (o) where t.total > coalesce(p.total, 0))
            select x.name as "left", y.name as "right", round(case when x.name = y.name then 1.0 else coalesce(case when l = r then 1.0 else 1 - osa / greatest(length(l), length(r)) end, 0.0) end, 6) as similarity from shown x cross join shown y left join judged on a = x.name and b = y.name""",
        "csv_harmonize": _grouped("noisy", True) + """ select row_number() over (order by row_id) - 1 as place, cast(row_id as bigint) as row_id, raw_name as name, concat('v "', v, '"', chr(10)) as note, proposed as name_canonical from noisy join grouped on raw_name = name join elected using ("group")""",
        "csv_changes": _grouped("noisy", True) + """ select name as original, proposed as canonical, name <> proposed as changed, occurrences, cast(dense_rank() over (order by "group") as int) as "group" from grouped join elected using ("group") join counts using (name)""",
        "mapping_document": f"""select id, members, proposed, case when status = 'edited' then concat('edited_', id) else proposed end as final, status, rows, method, min_similarity, true as reviewed from (
            select *, case when id % 3 = 0 then 'rejected' when id % 5 = 0 then 'edited' else 'accepted' end as status from (select * exclude (status, final) from ({_group_table("noisy")})))""",
        "near_misses": "with c as (select concat('Customer#', lpad(cast(c_custkey * 11 as varchar), 12, '0')) as name, cast(c_custkey * 11 as varchar) as d from customer), x as (select distinct name, concat(substr(d, 1, i - 1), substr(d, i + 1)) as d from (select name, d, unnest(range(1, length(d) + 1)) as i from c)) select distinct least(x.name, c.name) as \"left\", greatest(x.name, c.name) as \"right\" from x join c on x.d = c.d",
        "near_misses_dense": "with c as (select c_custkey as n, concat('Customer#', lpad(cast(c_custkey as varchar), 9, '0')) as name, cast(c_custkey as varchar) as d from customer where c_custkey % 10 in (0, 1, 5)), x as (select distinct n, name, concat(substr(d, 1, i - 1), substr(d, i + 1)) as d from (select n, name, d, unnest(range(1, length(d) + 1)) as i from c)), p as (select x.n as xn, c.n as yn, x.name as xname, c.name as yname from x join c on x.d = c.d) select distinct least(xname, yname) as \"left\", greatest(xname, yname) as \"right\" from p where not ((xn + 1 in (select n from c) or xn - 1 in (select n from c)) and (yn + 1 in (select n from c) or yn - 1 in (select n from c)))",
        "letter_variants": f"with {_NOISY} select least(x.raw_name, y.raw_name) as \"left\", greatest(x.raw_name, y.raw_name) as \"right\" from noisy x join noisy y on x.n = y.n and x.v in (0, 5) and y.v = 7",
        "apply_lookup": f"with {_NOISY}, {_LOOKUP}, {_FACTS}, {_APPLIED} select * from applied",
        "change_log": f"with {_NOISY}, {_LOOKUP}, {_FACTS}, {_CHANGES} select * from changes",
        "joined_without_decision": f"with {_NOISY}, {_LOOKUP}, {_FACTS} select distinct raw_name as name from facts where raw_name not in (select original from lookup) and raw_name in (select canonical from lookup where original <> canonical)",
        "change_summary": f"with {_NOISY}, {_LOOKUP}, {_FACTS}, {_APPLIED}, {_CHANGES} select count(*) as total_rows, count(distinct raw_name) as unique_names, cast(sum(cast(raw_name <> raw_name_canonical as int)) as bigint) as rows_changed, (select count(*) from changes) as names_in_the_mapping, (select count(*) from changes where changed) as names_changed, (select count(*) from changes where not changed) as names_unchanged from applied",
        "collisions": f"with {_NOISY}, {_DECIDED} select case when status = 'rejected' then raw_name else final end as name, string_agg(cast(id as varchar), '|' order by id) as ids from decided group by 1 having count(*) > 1",
        "resolved_mapping": f"with {_NOISY}, {_DECIDED} select raw_name as original, case when status = 'rejected' then raw_name else final end as canonical, id as \"group\" from decided",
        "qc_sizes": f"with {_NOISY}, {_GROUPS}, g as (select *, dense_rank() over (order by \"group\") as id from grouped) select cast(id as int) as id, concat('patient', max(n), '_batch', max(b)) as label, cast(count(*) as int) as spellings, count(*) as rows from g where v <> 7 group by id having count(*) > 1",
        "qc_counts": f"with {_NOISY}, {_GROUPS} select count(*) as names, count(distinct \"group\") as samples, count(distinct case when v <> 7 then n end) as merges, (select count(*) from noisy x join noisy y on x.n = y.n and x.v in (0, 5) and y.v = 7) as near_misses from grouped",
        "qc_flags": f"with {_NOISY} select least(x.raw_name, y.raw_name) as name, greatest(x.raw_name, y.raw_name) as other, 'substitution' as difference, 'no' as merged from noisy x join noisy y on x.n = y.n and x.v in (0, 5) and y.v = 7 order by name, other limit 9",
        "model_guard": f"with {_NOISY}, f as (select raw_name as name, n, b, {_sig('raw_name')} as s, {skeleton('raw_name')} as k from noisy), whole as (select s, bool_or(k = 'batientbatch') and bool_or(k = 'patientbatch') as bad from f group by 1), g as (select f.*, case when bad then min(name) over (partition by f.s, k) else min(name) over (partition by f.s) end as \"group\", bad from f join whole using (s)) select name, \"group\", case when n = '1' and (not bad or {skeleton(chr(34) + 'group' + chr(34))} = 'patientbatch') then concat('patient1_batch', b) else {_norm(chr(34) + 'group' + chr(34))} end as proposed from g",
    }
