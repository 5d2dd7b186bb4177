"""Working storage that every executor can reach.

Lineage is cut with tables written under the folder the cluster names in ``spark.checkpoint.dir``; an own folder is chosen only when
that setting is absent and driver and executors are one process. A table is deleted when what reads it has been written itself,
by :func:`release` or at the end of a :func:`scratch` block.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "/tmp/onomast-shared"
_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash; refused where executors are elsewhere and none is named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{LOCAL_FALLBACK}").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/onomast/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: the result has no lineage and no executor owns it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """At its end the tables made inside are deleted, but for those that the caller has put into the yielded list (which an outer
    block then answers for). What is left over after the block may read no other."""
    made, keep = [], []
    token = _made.set(made)
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        _made.reset(token)
        kept = {t.scratch for t in keep}
        release(*(t for t in made if t.scratch not in kept))
        if (outer := _made.get()) is not None:
            outer.extend(keep)


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` made. The caller knows that all that reads them has been written."""
    for table in tables:
        delete_path(table.sparkSession, table.scratch)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in as many partitions as the session shuffles into, by a hash of columns. Rows that are few bytes but much work would be
    brought together by their size otherwise; the planner leaves out a deal by columns that the rows are dealt by already."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
