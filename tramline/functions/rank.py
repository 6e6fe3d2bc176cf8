"""Ranks over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.sources.shared import written


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add row_number over ``order``: a range exchange, counts per range (one row each), then local numbers plus offsets.

    The order must end in a key that tells rows apart.  The dealt rows are written once: ranges come from a sample, so two
    evaluations of the exchange could differ.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def average_rank(df: DataFrame, value: str, name: str = "avg_rank", partitions: int | None = None) -> DataFrame:
    """Add the average rank of ``value``, ties sharing theirs; distinct values are ranked, so ties cost nothing.

    The rows are written once: ranks meet them again by value, and a sum computed twice may differ in its last bits.
    """
    df = written(df, "ranked")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(value).agg(F.count("*").alias("_ties"))
    dealt = written(counts.repartitionByRange(n, value).withColumn("_range", F.spark_partition_id()), "ranges")
    local = dealt.withColumn("_upto", F.sum("_ties").over(Window.partitionBy("_range").orderBy(value)))
    totals = dealt.groupBy("_range").agg(F.sum("_ties").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranks = local.join(F.broadcast(offsets), "_range").select(
        F.col(value).alias("_v"), (F.col("_before") + F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name), F.col("_ties").alias("ties")
    )
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")
