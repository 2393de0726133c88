"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows, so that there are no more hot keys than its inverse; their list is broadcast.
HOT_SHARE, HOT_LEAST = 1 / 1000, 10_000
SLICES = 64


def _hot(groups: DataFrame, n: str) -> Column:
    """Whether a group of n rows is hot among all groups; their sum is a subquery of the plan."""
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).scalar()
    return F.col(n) > F.greatest(F.lit(float(HOT_LEAST)), total * HOT_SHARE)


def hot_join(rows: DataFrame, groups: DataFrame, on: list[str], n: str, spread: str, how: str = "inner", sizes: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """rows joined (inner or left) to groups, which has one row per key and in column n how many rows the key has.

    Rows of hot keys are spread over SLICES by a hash of their column `spread`, and their group is repeated for each slice; the keys of hot groups
    are the only thing that is broadcast. sizes: a table (on, n) of all keys, where that is at hand and cheaper to read than groups.
    merge: groups are never broadcast, whatever their planned size.
    """
    known = groups if sizes is None else sizes
    hot = _hot(known, n)
    flags = known.filter(hot).select(*on, F.lit(True).alias("_hot"))
    left = rows.join(F.broadcast(flags), on, "left").withColumn("_slice", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SLICES)).cast("int")).otherwise(0)).drop("_hot")
    right = groups.withColumn("_hot", hot).withColumn("_slice", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right.hint("merge") if merge else right, [*on, "_slice"], how).drop("_slice")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, merge: bool = False) -> DataFrame:
    """left inner-joined to right, where right may have many rows per key. merge: neither is ever broadcast, whatever its planned size.

    Keys that hold more than HOT_SHARE of right's rows are counted first; their rows of right are spread over SLICES by a
    hash of the column `spread`, and their rows of left are repeated for each slice.
    """
    counts = right.groupBy(*on).agg(F.count("*").alias("_n"))
    hot = counts.filter(_hot(counts, "_n")).select(*on, F.lit(True).alias("_hot"))
    flagged = lambda df: df.join(F.broadcast(hot), on, "left")
    each = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0))))
    one = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SLICES)).cast("int")).otherwise(0)
    a, b = flagged(left).withColumn("_slice", each).drop("_hot"), flagged(right).withColumn("_slice", one).drop("_hot")
    return a.join(b.hint("merge") if merge else b, [*on, "_slice"]).drop("_slice")


def sliced_join(rows: DataFrame, groups: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined (inner, left, left_semi or left_anti) to groups, a small table with one row per key, of which it isn't known how many rows they have.

    rows are cut into SLICES by a hash of their column `spread`, and groups are repeated for each; so no key of any size is in one task.
    """
    each = groups.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return rows.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(SLICES)).cast("int")).join(each, [*on, "_slice"], how).drop("_slice")
