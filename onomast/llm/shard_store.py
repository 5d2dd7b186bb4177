"""Sharding by size-tiered compaction, with DataFrame operations only.

Append: arriving rows become small immutable shards, about an eighth of the target each, written where they are read (no exchange),
and a new version of the manifest lists them beside the live ones. Compact: live shards below the target are put into tiers by the
power of two of their size; within a tier they are packed, in order of a hash of their names, into runs of about the target size, and
each run is rewritten as one file, whether its members are arrivals or runs of earlier compactions. Shards of the target size or more,
and runs alone in their tier, stay as they are. A new version lists the new runs in place of their members.

Commit: files are written to folders of their own first, then the manifest aside, and one rename that never replaces anything makes
the version visible. Readers open what a version lists, and nothing else. A writer that dies before the rename leaves files that no
version lists and blocks nobody; one that loses the race for a number reads the new version and goes on from there, and is refused if
shards that it has merged were replaced meanwhile. Only :meth:`ShardStore.vacuum` deletes: what no retained version lists.

Scale: planning handles one row a shard, in groups of about 64 targets, so no task plans more than some hundred shards; a pass rewrites
about ``PASS_SHARDS`` shards at most, which bounds the plan that is broadcast, and passes follow each other until all are done. The
text moves once, in the rewrite, keyed by the run, whose size is bounded by the target. Nothing depends on the size of the corpus.

Defined cases: no rows give a version without a shard; null columns, empty and long texts and repeated rows are kept as they are; a
row larger than the target is a shard of its own size. Other columns are kept under their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from onomast.llm.columns import free_name
from onomast.plans.shared import delete_path, materialize, scratch, scratch_path

TARGET_BYTES = 128 << 20
ARRIVALS_PER_TARGET = 8
PASS_SHARDS = 100_000
GROUP_TARGETS = 64
MANIFEST = "shard string, folder string, arrival boolean, n_rows long, n_bytes long"


class Conflict(RuntimeError):
    """Shards that a writer has merged are no longer live."""


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's strings and 8 for any other value."""
    parts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") if t in ("string", "binary") else F.lit(8).cast("long") for c, t in ((f"`{c}`", t) for c, t in df.dtypes)]
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + p
    return total


class ShardStore:
    """A folder with ``arrivals/`` and ``runs/``, a folder in them for each write, and ``manifest/v=N`` (one row a live shard)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._Path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._Path(path).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        top = self._Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def versions(self) -> list[int]:
        """The versions that can be read; of those that vacuum has emptied only the number is taken."""
        return [v for v in self._numbers() if self._names(f"manifest/v={v}")]

    def _numbers(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names("manifest") if n.startswith("v="))

    def version(self) -> int:
        """The highest committed version, which vacuum never empties; 0 before the first."""
        return max(self._numbers(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version; of version 0, none."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={version}") if version else self.spark.createDataFrame([], MANIFEST)

    def commit(self, manifest: DataFrame, version: int) -> None:
        """Publish ``manifest`` as ``version``: written aside, then made visible by one rename that fails where the version exists."""
        aside = f"{self.path}/staged/{uuid.uuid4().hex}"
        manifest.select([c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.parquet(aside)
        goal = self._Path(f"{self.path}/manifest/v={version}")
        self._fs.mkdirs(goal.getParent())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), self._conf).rename(self._Path(aside), goal, options)
        except Exception as e:
            delete_path(self.spark, aside)
            if self._fs.exists(goal):
                raise FileExistsError(f"version {version} has been committed by another writer") from e
            raise

    def publish(self, added: DataFrame, replaced: DataFrame | None = None, attempts: int = 16) -> int:
        """Commit the live shards of the latest version with ``added`` and without ``replaced`` (``folder, shard``); the version.

        Another writer's commit in between is built upon; Conflict if it has replaced a shard of ``replaced``."""
        for _ in range(attempts):
            base = self.version()
            live = self.manifest(base)
            if replaced is not None:
                if not replaced.join(live, ["folder", "shard"], "left_anti").isEmpty():
                    raise Conflict("shards that were merged have been replaced by another writer")
                live = live.join(replaced, ["folder", "shard"], "left_anti")
            try:
                self.commit(live.unionByName(added), base + 1)
                return base + 1
            except FileExistsError:
                continue
        raise FileExistsError(f"no version could be committed in {attempts} attempts")

    def append(self, df: DataFrame, target: int = TARGET_BYTES) -> int:
        """Write the rows as small immutable shards and list them; the version."""
        size = df.select(row_bytes(df).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
        folder = f"{self.path}/arrivals/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", max(1, int(target * size["n"] // max(1, size["b"] * ARRIVALS_PER_TARGET)))).parquet(folder)
        arrived = self._read(folder, True, df.schema, "shard_name")
        listed = arrived.groupBy(F.col("shard_name").alias("shard")).agg(F.count("*").alias("n_rows"), F.sum(row_bytes(df)).alias("n_bytes"))
        return self.publish(materialize(listed.withColumns({"folder": F.lit(folder), "arrival": F.lit(True)}), "arrived"))

    def _read(self, folder: str, arrival: bool, schema: T.StructType, shard_id: str) -> DataFrame:
        """The rows of a folder with their shard: a file of ``arrivals``, a partition of ``runs``."""
        if arrival:
            rows = self.spark.read.schema(schema).parquet(folder)
            return rows.withColumn(shard_id, F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
        inside = free_name(self.spark.createDataFrame([], schema), "shard_id")
        return self.spark.read.schema(T.StructType([*schema, T.StructField(inside, T.StringType())])).parquet(folder).withColumnRenamed(inside, shard_id)

    def plan(self, live: DataFrame, target: int) -> DataFrame:
        """``folder, shard, run`` of the shards to merge (and their ``n_rows, n_bytes``): runs of about ``target`` bytes of one tier."""
        small = live.where(F.col("n_bytes") < target)
        total = small.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("t")).first()["t"]
        groups = max(1, total // (GROUP_TARGETS * target))
        name = F.xxhash64("shard", "folder")
        placed = small.withColumns({"tier": F.floor(F.log2(F.greatest("n_bytes", F.lit(1)))), "group": F.pmod(name, F.lit(groups))})
        before = F.sum("n_bytes").over(Window.partitionBy("tier", "group").orderBy(name, "shard", "folder")) - F.col("n_bytes")
        runs = placed.withColumn("run", F.concat_ws("-", F.lit(f"v{self.version() + 1}"), "tier", "group", F.floor(before / target)))
        run = Window.partitionBy("run")
        worth = (F.count("*").over(run) > 1) | F.max("arrival").over(run)
        return runs.withColumn("worth", worth).where("worth").select("folder", "shard", "arrival", "n_rows", "n_bytes", "run")

    def compact(self, schema: T.StructType, target: int = TARGET_BYTES, pass_shards: int = PASS_SHARDS) -> int:
        """Merge similarly sized live shards into runs of about ``target`` bytes; the version."""
        with scratch():
            plan = materialize(self.plan(self.manifest(), target), "plan")
            n = plan.count()
            for i in range(passes := -(-n // pass_shards)):
                part = plan.where(F.pmod(F.xxhash64("run"), F.lit(passes)) == i)
                self._rewrite(part, schema)
        return self.version()

    def _rewrite(self, plan: DataFrame, schema: T.StructType) -> None:
        empty = self.spark.createDataFrame([], schema)
        shard_id, member = free_name(empty, "shard_id"), free_name(empty, "member")
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        merged = None
        for source in plan.select("folder", "arrival").distinct().collect():  # a row for each write since the last compaction
            members = plan.where(F.col("folder") == source["folder"]).select(F.col("shard").alias(member), F.col("run").alias(shard_id))
            rows = self._read(source["folder"], source["arrival"], schema, member).join(F.broadcast(members), member).drop(member)  # about PASS_SHARDS rows
            merged = rows if merged is None else merged.unionByName(rows)
        if merged is None:
            return
        runs = materialize(plan.groupBy(F.col("run").alias("shard")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")), "runs")
        width = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), runs.count())
        merged.repartition(width, shard_id).write.option("compression", "zstd").partitionBy(shard_id).parquet(folder)
        self.publish(runs.withColumns({"folder": F.lit(folder), "arrival": F.lit(False)}), plan.select("folder", "shard"))

    def rows(self, schema: T.StructType, version: int | None = None, shard_id: str = "shard_id") -> DataFrame:
        """The rows of a version's live shards, with their shard in a further column."""
        live = self.manifest(version)
        out = None
        for r in live.groupBy("folder", "arrival").agg(F.count("*").alias("n")).collect():  # a row for each write that is still live
            found = self._read(r["folder"], r["arrival"], schema, shard_id)
            if self._holds(r["folder"], r["arrival"]) != r["n"]:
                found = found.join(live.where(F.col("folder") == r["folder"]).select(F.col("shard").alias(shard_id)), shard_id, "left_semi").select(found.columns)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], T.StructType([*schema, T.StructField(shard_id, T.StringType())])) if out is None else out

    def _holds(self, folder: str, arrival: bool) -> int:
        """The number of shards in a folder."""
        names = self._names(folder.removeprefix(f"{self.path}/"))
        return sum(n.startswith("part-") if arrival else "=" in n for n in names)

    def vacuum(self, retain: int = 1) -> None:
        """Delete what none of the latest ``retain`` versions (one at least) lists, and what writers have left. Not beside a writer."""
        retain = max(1, retain)
        versions = self.versions()
        for v in versions[: max(0, len(versions) - retain)]:
            for n in self._names(f"manifest/v={v}"):  # the empty folder stays, so that no late writer can take the number
                delete_path(self.spark, f"{self.path}/manifest/v={v}/{n}")
        delete_path(self.spark, f"{self.path}/staged")
        live = None
        for v in versions[-retain:]:
            listed = self.manifest(v).select("folder", "shard", "arrival")
            live = listed if live is None else live.union(listed).distinct()
        sizes = {r["folder"]: (r["n"], r["arrival"]) for r in live.groupBy("folder", "arrival").agg(F.count("*").alias("n")).collect()} if live is not None else {}
        for kind in ("arrivals", "runs"):
            for name in self._names(kind):
                folder = f"{self.path}/{kind}/{name}"
                if folder not in sizes:
                    delete_path(self.spark, folder)
                elif self._holds(folder, sizes[folder][1]) != sizes[folder][0]:
                    kept = {r["shard"] for r in live.where(F.col("folder") == folder).collect()}
                    for n in self._names(f"{kind}/{name}"):
                        shard_name = n.split(".")[0] if kind == "arrivals" else n.partition("=")[2]
                        if not n.startswith(("_", ".")) and shard_name not in kept:
                            delete_path(self.spark, f"{folder}/{n}")


def shard(docs: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES) -> tuple[ShardStore, DataFrame]:
    """Append ``docs`` to the store at ``path`` (a new one by default) and compact it; the store and the rows of its live shards, all
    columns of ``docs`` plus ``shard_id`` (``shard_id_`` and so on where ``docs`` has that name)."""
    store = ShardStore(docs.sparkSession, path or scratch_path(docs.sparkSession, "store"))
    store.append(docs, target_bytes)
    store.compact(docs.schema, target_bytes)
    store.vacuum()
    return store, store.rows(docs.schema, shard_id=free_name(docs, "shard_id"))
