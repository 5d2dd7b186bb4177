"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import binary_codes, decontaminate, disclosure, mixing, near_dup, repeated_passages, shard_store, token_counts, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures in global order of URL key and timestamp."""
    index = warc.archive_and_index(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.span_digest(disclosure.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the shard that holds it after compaction."""
    docs = _table(spark, sf_dir, "documents")
    _, rows = shard_store.shard(docs)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "source", "shard_id")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash", "group_key")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_disclosure, op3_token_counts, op4_shard_compaction, op5_repeated_passages, op6_near_duplicates, op7_decontaminate, op8_mix, op9_near_vectors, op10_toxicity)}


_COMPONENTS = """
    reach as (select a as v, a as r from both_ways union select a, b from both_ways union select reach.v, both_ways.b from reach join both_ways on reach.r = both_ways.a)"""

_SHINGLES = r"""
    w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1))) when len(w) > 0 then [array_to_string(w, chr(1))] else [] end) as g from w),
    n as (select doc_id, count(*) as n from s group by 1),
    shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
    links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k))"""

_GRAMS = r"""
    dw as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
    iw as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
    p as (select distinct item_id, least(len(w), 13) as m, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) as g from iw where len(w) > 0),
    ms as (select distinct m from p),
    dg as (select doc_id, m, unnest(range(1, len(w) - m + 2)) as i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as g from dw, ms where len(w) >= m),
    hits as (select doc_id, item_id, i, dg.m from dg join p on dg.m = p.m and dg.g = p.g),
    words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from hits) group by 1),
    items as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct doc_id, cast(item_id as varchar) as k from hits) group by 1)"""


#: Base spans by place, then every pair of an entity and a term by plain counts of documents.
_DISCLOSURE = r"""
    with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents), total as (select count(*) as total from d),
    kinds as (select * from (values (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'), (4, 'term', '\p{L}{3,}')) as v(kind, name, pattern)),
    lists as (select k, kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as ms, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as gs from d, kinds where kind = 0
      union all select k, kind, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') from d, kinds where kind = 1
      union all select k, kind, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') from d, kinds where kind = 2
      union all select k, kind, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') from d, kinds where kind = 3
      union all select k, kind, regexp_extract_all(t, '\p{L}{3,}'), string_split_regex(t, '\p{L}{3,}') from d, kinds where kind = 4),
    each as (select k, kind, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(gs[1:len(ms)]) as g from lists),
    placed as (select k, kind, m, cast(sum(length(g) + length(m)) over (partition by k, kind order by i) as bigint) as e, regexp_replace(m, '[^0-9]', '', 'g') as digits from each),
    base as (select k, kind, e - length(m) as s, e, case kind when 0 then concat('email:', lower(m)) when 1 then concat('ip:', m) when 2 then concat('card:', digits) else concat('phone:', digits) end as entity from placed where case kind
      when 0 then true when 1 then regexp_full_match(m, 'OCTET(\.OCTET){3}') when 2 then length(digits) between 12 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda j: cast(digits[length(digits) - j + 1] as int) * (2 - j % 2) - case when j % 2 = 0 and digits[length(digits) - j + 1] > '4' then 9 else 0 end)) % 10 = 0
      when 3 then length(digits) between 9 and 15 else false end),
    ents as (select distinct k, entity from base), words as (select distinct k, unnest(regexp_extract_all(lower(t), '\p{L}{3,}')) as term from d),
    ne as (select entity, count(*) as n_entity from ents group by 1), nt as (select term, count(*) as n_term from words group by 1),
    terms as (select distinct term from (select entity, term, count(*) as n from ents join words using (k) group by 1, 2) join ne using (entity) join nt using (term), total
      where log2(total / n_entity) > 0 and log2(n / n_term * total / n_entity) >= 0.95 * log2(total / n_entity)),
    found as (select k, 4 as kind, e - length(m) as s, e from placed where kind = 4 and lower(m) in (select term from terms)),
    apart as (select * from found f where not exists (select 1 from base b where b.k = f.k and f.s < b.e and b.s < f.e)),
    counts as (select k, count(*) filter (kind = 0) as n_email, count(*) filter (kind = 1) as n_ip, count(*) filter (kind = 2) as n_card, count(*) filter (kind = 3) as n_phone, string_agg(concat(name, ':', s, ':', e), ',' order by s, kind) as written from base join kinds using (kind) group by k),
    everything as (select k, count(*) filter (kind = 4) as n_term, string_agg(concat(name, ':', s, ':', e), ',' order by s, kind, e) as spans from (select k, kind, s, e from base union all select k, kind, s, e from apart) join kinds using (kind) group by k)
    select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(written, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_term, 0) as n_term from d left join counts using (k) left join everything using (k)""".replace("OCTET", "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])")

#: Every word cut into longest tokens from the left, a step for all words at a time; the vocabulary is read from its file.
_TOKENS = r"""
    with recursive v as (select unnest(json_keys(content, '$.model.vocab')) as token from read_text('VOCABULARY')),
    longest as (select max(length(token)) as most from v),
    bytes as (select b, b between 33 and 126 or b between 161 and 172 or b between 174 and 255 as shown from (select unnest(range(256)) as b)),
    alphabet as (select list(case when shown then chr(cast(b as int)) else chr(cast(256 + fresh as int)) end order by b) as a from (select b, shown, row_number() over (partition by shown order by b) - 1 as fresh from bytes)),
    d as (select doc_id, row_number() over () as k, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '''s|''t|''re|''ve|''m|''ll|''d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+') as ws from documents),
    each as (select k, unnest(ws) as word from d),
    words as (select word, list_append(list_transform(range(0, octet_length(encode(word))), lambda i: a[cast(concat('0x', hex(encode(word))[2 * i + 1:2 * i + 2]) as int) + 1]), '</w>') as s from (select distinct word from each), alphabet),
    cut as (select word, s, cast(1 as bigint) as p, cast(0 as bigint) as n from words
      union all select word, any_value(s), p + max(j), any_value(n) + 1 from (select word, s, p, n, unnest(range(1, least(len(s) - p + 1, most) + 1)) as j from cut, longest where p <= len(s)) join v on token = array_to_string(s[p:p + j - 1], '') group by word, p),
    counted as (select word, coalesce(max(n) filter (p > len(s)), 1) as n from cut group by word),
    sums as (select k, count(*) as n_words, cast(sum(n) as bigint) as n_tokens from each join counted using (word) group by k)
    select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_tokens, 0) as n_tokens from d left join sums using (k)""".replace("VOCABULARY", token_counts.VOCABULARY)

#: All 400-byte strings by place, those that occur twice, their runs, what is left.
_REPEATS = """
    with b as (select row_number() over () as k, doc_id, encode(coalesce(text, '')) as b from documents),
    w as (select k, i, md5(b[i:i + 399]) as h from (select k, b, unnest(range(1, greatest(octet_length(b) - 398, 1))) as i from b)),
    r as (select k, i from (select k, i, count(*) over (partition by h) as c from w) where c > 1),
    m as (select k, i, sum(n) over (partition by k order by i) as g from (select k, i, case when i - lag(i) over (partition by k order by i) <= 400 then 0 else 1 end as n from r)),
    s as (select k, min(i) as s, max(i) + 400 as e from m group by k, g),
    p as (select k, s, e, coalesce(lag(e) over (partition by k order by s), 1) as f from s),
    t as (select k, sum(e - s) as n_removed, count(*) as n_spans, max(e) as last from p group by k),
    kept as (select p.k, list_reduce(list(b[f:s - 1] order by s), lambda x, y: x || y) as head from p join b using (k) group by p.k)
    select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(case when last is null then b else head || b[last:] end) as kept_sha256
    from b left join t using (k) left join kept using (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, cast(octet_length(encode(h)) as bigint) as n, sha256(h) as s from p),
            f as (select *, min(page_id) over (partition by s) as first from d)
            select page_id, n as payload_bytes, s as payload_digest, case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id <> first then first end as refers_to from f""",
        "op2_disclosure": _DISCLOSURE,
        "op3_token_counts": _TOKENS,
        "op5_repeated_passages": _REPEATS,
        "op6_near_duplicates": f"""with recursive {_SHINGLES}, both_ways as (select a, b from links union all select b, a from links), {_COMPONENTS},
            c as (select v, min(r) as component_id from reach group by 1)
            select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, d.doc_id = coalesce(c.component_id, d.doc_id) as kept from documents d left join n using (doc_id) left join c on c.v = d.doc_id""",
        "op7_decontaminate": f"""with {_GRAMS} select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from dw left join words using (doc_id) left join items using (doc_id)""",
        "op9_near_vectors": f"""with recursive x as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
            both_ways as (select p.vec_id as a, q.vec_id as b from x p join x q on p.vec_id <> q.vec_id and len(p.e) = len(q.e) and list_cosine_similarity(p.e, q.e) >= 0.95), {_COMPONENTS},
            c as (select v, min(r) as component_id from reach group by 1), n as (select a, count(*) as k from both_ways group by 1)
            select vec_id, coalesce(k, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept from embeddings left join n on a = vec_id left join c on v = vec_id""",
    }
