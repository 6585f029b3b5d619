"""Row positions of a sorted table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.storage import stored


def numbered(df: DataFrame, order: list[str], name: str = "edge_seq") -> DataFrame:
    """df with its rank from 0 in the order of the columns; rows that tie in all of them are interchangeable.

    Range-partitioned and sorted, written once (so that positions can't change), then each partition counts on from
    the rows before it. Only one count a partition is brought together.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("__part").orderBy(*order)
    # one row a partition
    ranked = parts.withColumn("__in", F.row_number().over(within)).join(F.broadcast(offsets), "__part")
    return ranked.withColumn(name, (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__part", "__in", "__before")
