"""Global order without a global window: dense ids and average ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.session import cut


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense ids from 0 in the given total order. Rows are range-partitioned and numbered within partitions; the partitions' offsets, one row each, are added by broadcast.

    The range partitioning is checkpointed, as the numbers are only right while it stays the same.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    numbered = parts.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_row") + F.col("_before") - 1).cast("long")).drop("_part", "_row", "_before")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the average rank of each distinct value, from the counts per value."""
    n = cut(df.groupBy(column).agg(F.count(F.lit(1)).alias("_c")).repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id()))
    inside = n.withColumn("_b", F.sum("_c").over(W.partitionBy("_part").orderBy(column)) - F.col("_c"))
    offsets = n.groupBy("_part").agg(F.sum("_c").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return inside.join(F.broadcast(offsets), "_part").select(column, (F.col("_before") + F.col("_b") + (F.col("_c") + 1) / 2).alias(name))
