"""Personal data and the words that give it away, with DataFrame functions only.

Base: emails, IPv4 addresses, card numbers (Luhn) and phone numbers by pattern, leftmost and non-overlapping within a kind, as spans
of code points.

Method (information-theoretic sanitisation): each distinct base value is a protected entity c. Over all documents, a term t (a word of
three letters or more, lower-cased) co-occurs with c in a document that holds both, wherever they stand. With
p(c) = df(c)/D, t discloses c as far as PMI(c;t) = log2(p(c|t)/p(c)) comes to IC(c) = -log2 p(c). Terms with
PMI >= ``ALPHA`` * IC are sanitised, however few documents hold c, wherever they occur: removed if nothing but c explains them
(p(c|t) = 1), else generalised to a placeholder. Term spans never overlap base spans; base spans are kept as they are.

Scale: base spans need no exchange. Documents that hold an entity are written once as their distinct words and entities. Terms that
no entity can reach by exact bounds on their counts go before any pair is made; words are counted over all documents, but only those
whose hash bucket, one of ``BUCKETS``, holds a term that is left; the table of buckets is bounded by that number and broadcast.
Entities of the same documents are one, and terms of a single document need no pairs. What is left is paired within a document.

Defined cases: a null or empty text has no spans; a null doc_id is a value like another, and no decision depends on doc_id; repeated
rows count as documents of their own; no rows or no entity give no term. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.plans.shared import materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive forms of the patterns, which match the same and neither recurse nor rescan a run of characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD = r"\p{L}{3,}"
ALPHA = 0.95
BUCKETS = 1 << 20
PIECE = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda: F.length(digits).between(12, 19) & F.call_function("luhn_check", digits),
        "phone": lambda: F.length(digits).between(9, 15),
    }[kind]()


def _matches(text: Column, pattern: str) -> Column:
    """Array of (before, match): each match with the text between it and the one before."""
    # Zipped, since an expression inside a lambda is evaluated anew for each element; there is one gap more than matches.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(g.alias("before"), m.alias("match")))
    return F.filter(both, lambda x: x["match"].isNotNull())


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once: what stands in a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _located(matches: Column, keep: Callable[[Column], Column], kind: int) -> Column:
    """Spans of the matches that ``keep`` accepts, from the lengths of what comes before them.

    Appending copies an array, so matches are taken ``PIECE`` at a time: first the place at which each piece starts, then its spans."""
    rows = F.transform(matches, lambda x: F.struct(F.length(x["before"]).alias("skip"), F.length(x["match"]).alias("size"), keep(x["match"]).alias("keep")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["skip"]
        span = F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + x["size"]).alias("end"))
        return F.struct((s + x["size"]).alias("at"), F.when(x["keep"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def starts(pieces: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        total = lambda piece: F.aggregate(piece, F.lit(0), lambda n, x: n + x["skip"] + x["size"])
        return F.aggregate(pieces, first, lambda acc, p: F.struct((acc["at"] + total(p)).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])

    def spans(piece: Column, at: Column) -> Column:
        return F.aggregate(piece, F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda acc: acc["spans"])

    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor(F.size(r) / PIECE).cast("int")), lambda i: F.slice(r, i * PIECE + 1, F.lit(PIECE)))
    return _bound(rows, lambda r: _bound(cut(r), lambda pieces: F.flatten(F.zip_with(pieces, starts(pieces), spans))))


def base_spans(text: Column) -> Column:
    """All base spans, sorted by start and kind."""
    found = [_located(_matches(text, PATTERNS[k]), functools.partial(_valid, k), i) for i, k in enumerate(KINDS[:4])]
    empty = F.array().cast(SPAN)
    found[0] = F.when(F.contains(text, F.lit("@")), found[0]).otherwise(empty)
    found[3] = F.when(F.contains(text, F.lit("+")), found[3]).otherwise(empty)
    return F.array_sort(F.concat(*found))


def _entity(kind: str, m: Column) -> Column:
    value = {"email": F.lower(m), "ip": m}.get(kind, F.regexp_replace(m, "[^0-9]", ""))
    return F.concat(F.lit(f"{kind}:"), value)


def _entities(text: Column) -> Column:
    """The distinct values of base matches, each after its kind."""
    parts = []
    for kind, trigger in zip(KINDS[:4], ("@", ".", None, "+")):
        found = F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), functools.partial(_valid, kind))
        values = F.transform(found, functools.partial(_entity, kind))
        parts.append(F.when(F.contains(text, F.lit(trigger)), values).otherwise(F.array().cast("array<string>")) if trigger else values)
    return F.array_distinct(F.concat(*parts))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS))


def _in_buckets(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``words`` whose bucket holds one of ``terms``."""
    buckets = F.broadcast(terms.select(_bucket().alias("bucket")).distinct())  # at most BUCKETS rows
    return words.withColumn("bucket", _bucket()).join(buckets, "bucket", "left_semi").drop("bucket")


def _occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """h, term: words of every text whose bucket holds one of ``terms``, once a row; h is a hash of the text."""
    return _in_buckets(texts.select(F.xxhash64("text").alias("h"), F.explode(_words(F.col("text"))).alias("term")), terms).select("h", "term")


def disclosing_terms(texts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """term, certain: the terms to sanitise; certain if every document with the term holds one entity."""
    total = texts.count()

    def discloses(n: str | Column, n_term: str, n_entity: str | Column) -> Column:
        n, n_entity = (F.col(c) if isinstance(c, str) else c for c in (n, n_entity))
        ic = F.log2(total / n_entity)
        return (ic > 0) & (F.log2(n / F.col(n_term) * total / n_entity) >= alpha * ic)

    private = texts.select(F.xxhash64("text").alias("h"), _entities(F.col("text")).alias("entities"), _words(F.col("text")).alias("terms")).where(F.size("entities") > 0)
    private = materialize(private, "private")
    held = materialize(private.select("h", F.explode("entities").alias("entity")).groupBy("h", "entity").agg(F.count("*").alias("w")), "entities")
    # Entities of the same documents disclose the same terms: from here on they are one, named by a hash of those documents.
    same = F.xxhash64(F.sum("w"), F.count("*"), F.bit_xor(F.xxhash64(F.lit(7), "h")), F.sum(F.xxhash64(F.lit(11), "h").cast("decimal(38,0)")))
    counted = materialize(held.groupBy("entity").agg(F.sum("w").alias("n_entity"), same.alias("e")).where(F.col("n_entity") < total), "entity-counts")
    sets = materialize(held.join(counted, "entity").select("h", "e", "n_entity").distinct(), "entity-sets")
    # With n_beside documents that hold the term and an entity, and at most ``most`` with any one entity, the ratio is greatest for an
    # entity in min(n_beside, most) documents, all with the term. What fails with that can't disclose; n_beside also bounds n_term.
    best = F.least("n_beside", "most")
    words = private.join(sets.groupBy("h").agg(F.max("n_entity").alias("most")), "h").select("most", F.explode("terms").alias("term"))
    beside = words.groupBy("term").agg(F.count("*").alias("n_beside"), F.max("most").alias("most"))
    beside = materialize(beside.where(discloses(best, "n_beside", best)), "beside-any")
    counts = materialize(_occurrences(texts, beside).groupBy("term").agg(F.count("*").alias("n_term")), "term-counts")
    known = materialize(beside.join(counts, "term").where(discloses(best, "n_term", best)).select("term", "n_beside", "n_term"), "known")
    # A term of one document is disclosed by any entity of it, so it needs no pairs.
    single = known.where("n_term = 1").select("term", F.lit(True).alias("certain"))
    several = known.where("n_term > 1")
    rows = _in_buckets(private.select("h", F.explode("terms").alias("term")), several).groupBy("h", "term").agg(F.count("*").alias("w"))
    near = materialize(rows.join(several, "term"), "near")
    pairs = near.join(sets, "h").where(discloses(F.least("n_beside", "n_entity"), "n_term", "n_entity"))
    pairs = pairs.groupBy("term", "e", "n_entity", "n_term").agg(F.sum("w").alias("n")).where(discloses("n", "n_term", "n_entity"))
    return materialize(pairs.groupBy("term").agg(F.max(F.col("n") >= F.col("n_term")).alias("certain")).union(single), "disclosing")


def find_spans(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """All columns of ``docs`` plus ``__base`` and ``__terms``, arrays of spans; kinds by number in ``KINDS``, and for terms
    ``__certain``, those to remove."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = disclosing_terms(texts, alpha)
    # Rows of one text share its terms, so a group holds no more than the distinct words of a text, however often it is repeated.
    hits = _occurrences(texts, terms).join(terms, "term").groupBy("h").agg(F.collect_set("term").alias("__all"), F.collect_set(F.when(F.col("certain"), F.col("term"))).alias("__certain"))
    hits = materialize(hits.withColumnRenamed("h", "__h"), "term-hits")
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.withColumns({"__base": base_spans(text), "__h": F.xxhash64(text)})
    joined = based.join(hits, "__h", "left").drop("__h")
    found = _located(_matches(text, WORD), lambda m: F.array_contains("__all", F.lower(m)), 4)
    apart = F.filter(found, lambda t: ~F.exists("__base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return joined.withColumn("__terms", F.when(F.col("__all").isNotNull(), apart).otherwise(F.array().cast(SPAN))).drop("__all")


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of base spans and all spans in writing."""
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    everything = F.array_sort(F.concat("__base", "__terms"))
    return found.select("doc_id", *counts, F.sha2(_written(F.col("__base")), 256).alias("base_sha256"), _written(everything).alias("spans"), F.size("__terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with its text sanitised: base spans replaced by their kind, disclosing terms generalised to ``[TERM]`` or removed."""
    found = find_spans(docs, alpha)
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        word = F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        gone = (s["kind"] == 4) & F.array_contains(F.coalesce("__certain", F.array().cast("array<string>")), word)
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.when(gone, F.lit("")).otherwise(F.get(labels, s["kind"])))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), put.alias("out")))

    done = F.aggregate(F.array_sort(F.concat("__base", "__terms")), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), done)).select(*docs.columns)
