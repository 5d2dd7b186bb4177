"""Row numbers over a total order without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onomast.plans.shared import materialize


def number_rows(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Append ``name``: the place of each row in the order (which should be total), from range partitions and their offsets."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes, offsets = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()), []
    total = first - 1
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    # One row for each partition, so the table is no longer than their number.
    table = df.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(table), "__part").withColumn(name, place + F.col("__offset")).drop("__part", "__offset")
