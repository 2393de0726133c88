"""Ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the order that ranks go by.
BITS = 60
#: Buckets of a group for each shuffle partition.
BUCKETS = 4


def group_rank(df: DataFrame, group: str, order: Column, ties: list[str], name: str) -> DataFrame:
    """df with column `name`: the rank from 1 of each row in its group by `order`, a hash of BITS bits that isn't negative, and then by the columns `ties`.

    The hash's range is cut into as many buckets as BUCKETS for each shuffle partition of the session, which are ranked on their own; the prefix sums of the buckets' counts (one row per group and
    bucket) make ranks of the whole group. A group of any size is spread over its buckets.
    """
    buckets = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = BITS - max(0, buckets - 1).bit_length()
    held = df.withColumn("_order", order).withColumn("_bucket", F.shiftright("_order", shift))
    counts = held.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_order", *ties))
    joined = held.withColumn("_own", own).join(offsets, [group, "_bucket"])
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_order", "_bucket", "_before", "_own")


def total_rank(df: DataFrame, bucket: list[str], order: list[str], name: str) -> DataFrame:
    """df with column `name`: the rank from 1 of each row in the order of the columns `bucket`, then `order`.

    Rows are ranked within their bucket, and the counts of the buckets (a row each) are summed up in their order. Choose buckets so that none holds many rows; they may not be null.
    """
    counts = df.groupBy(*bucket).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    return df.withColumn("_own", own).join(counts.select(*bucket, before.alias("_before")), bucket).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before")
