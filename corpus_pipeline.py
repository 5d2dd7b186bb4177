"""A training corpus from raw documents: toxicity, near duplicates, benchmark contamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. All stages but the last return the columns of ``docs``; the last adds ``shard_id``. A stage judges all rows that it is
given: rows with null or empty texts are neither toxic, linked nor contaminated and stay until the mix, which takes documents
by their words and so takes none of them. Columns may have any names beside ``doc_id, text, source``. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import decontaminate, mixing, near_dup, shard_store, toxicity
from onomast.llm.columns import free_name
from onomast.plans.shared import materialize, release, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on labels outside the held-out fold, doesn't score as toxic."""
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(spark, model)("text") < 0.5)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least doc_id, of its texts the one with the least hash, of repeated rows one.

    A row is known by two hashes of doc_id and text, so one doc_id on several texts is judged text by text. Repeated rows are combined
    where they are read, before anything is exchanged. Rows without words pass by."""
    judged = near_dup.near_duplicates(docs).where("group_key is not null")
    first = judged.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("r")).select("r.doc_id", "r.text_hash")
    row, other = free_name(docs, "row"), free_name(docs, "other")
    keys = lambda text_hash: {row: F.xxhash64("doc_id", text_hash), other: F.xxhash64(text_hash, F.lit(1), "doc_id")}
    kept = materialize(first.withColumns(keys("text_hash")).select(row, other), "kept")
    said = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    rows = docs.where(said).withColumns(keys(F.xxhash64("text"))).dropDuplicates([row, other])
    return rows.join(kept, [row, other], "left_semi").select(docs.columns).union(docs.where(~said))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of benchmark text, however long they are."""
    hits = free_name(docs, "hits")
    found = decontaminate.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits)
    return found.where(F.size(F.col(hits)["spans"]) == 0).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.copies_of(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard that holds them in the committed version."""
    return shard_store.shard(docs)[1]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: The fitted classifier and the seeded mix aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's working tables go when its result is written, its input when the next has been."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch():
        for name, stage in STAGES[:-1]:
            with scratch() as result:
                done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
                result.append(done)
            if name != STAGES[0][0]:
                release(docs)
            docs = done
        return STAGES[-1][1](spark, docs, sf_dir)  # it has written its rows to a store
