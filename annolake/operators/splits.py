"""Stratified splits and coverage-aware samples in a random order that any engine can repeat: the MD5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.operators.ranks import group_rank
from annolake.operators.skew import hot_join


def order_hash(seed: int, key: str) -> Column:
    """60 bits of the MD5 of 'seed|key'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")


def with_stratum(df: DataFrame, least: int) -> DataFrame:
    """df (l1, l2, l3) with `stratum`: the lowest level whose class is large enough, of l3 with `least` rows or more, else l2, l1 or UNK."""
    keyed = df.withColumn("_k", F.coalesce("l3", F.lit(""))).withColumn("_s", F.xxhash64(*df.columns))
    counts = keyed.groupBy("_k").agg(F.count("*").alias("_n"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    named = F.when(filled("l3") & (F.col("_n") >= least), F.concat(F.lit("L3::"), "l3")).when(filled("l2"), F.concat(F.lit("L2::"), "l2")).when(filled("l1"), F.concat(F.lit("L1::"), "l1")).otherwise("UNK")
    return hot_join(keyed, counts, ["_k"], "_n", "_s").withColumn("stratum", named).select(*df.columns, "stratum")


def split_sizes(counts: DataFrame, train: float, val: float) -> DataFrame:
    """counts (stratum, n) with n_train, n_val and n_test. One row trains, of two one tests; from three on each has its share, and the test never goes empty."""
    if train < 0 or val < 0 or train + val > 1 + 1e-6:
        raise ValueError("shares must not pass 1")
    n = F.col("n")
    a = F.greatest(F.lit(1), F.rint(n * train).cast("bigint"))
    rest = n - a
    b = F.least(F.rint(n * val).cast("bigint"), rest)
    b = F.when(rest - b > 0, b).when(rest > 0, rest - 1).otherwise(0)
    return counts.withColumn("n_train", F.when(n <= 2, F.lit(1)).otherwise(a).cast("bigint")).withColumn("n_val", F.when(n <= 2, F.lit(0)).otherwise(b).cast("bigint")).withColumn("n_test", n - F.col("n_train") - F.col("n_val"))


def split(df: DataFrame, key: str, train: float, val: float, least: int, seed: int) -> DataFrame:
    """df (l1, l2, l3, key) with stratum and split. Every row is in exactly one split; strata of any size are ranked in parallel."""
    strata = with_stratum(df, least)
    sizes = split_sizes(strata.groupBy("stratum").agg(F.count("*").alias("n")), train, val)
    ranked = group_rank(strata, "stratum", order_hash(seed, key), [key], "_rank")
    name = F.when(F.col("_rank") <= F.col("_a"), "train").when(F.col("_rank") <= F.col("_a") + F.col("_b"), "val").otherwise("test")
    sizes = sizes.select("stratum", F.col("n").alias("_n"), F.col("n_train").alias("_a"), F.col("n_val").alias("_b"))
    return hot_join(ranked, sizes, ["stratum"], "_n", key).withColumn("split", name).drop("_rank", "_a", "_b", "_n")


def coverage_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows of df (l2, l3, key) with `phase`: first a row of each l2 (if they fit), then of each l3 not yet there, rarest first, then l2 by their shares, then any.

    Two passes over the rows: one makes a row per pair of labels, which is enough for the first two phases and the shares; the other keeps the first 2 x size rows of each l2, among which
    the rows of the last two are. What follows is over these few rows.
    """
    rows = df.select(F.struct(order_hash(seed, key).alias("h"), F.col(key).alias("k")).alias("_h"), F.struct(*df.columns).alias("_row"), "l2", "l3")
    every, l2, l3 = Window.partitionBy(), Window.partitionBy("l2"), Window.partitionBy("l3")
    pairs = rows.groupBy("l2", "l3").agg(F.min(F.struct("_h", "_row")).alias("f"), F.count("*").alias("n")).select("l2", "l3", "n", "f.*")
    pairs = pairs.withColumns({"n2": F.sum("n").over(l2), "n3": F.sum("n").over(l3), "r2": F.row_number().over(l2.orderBy("_h")), "r3": F.row_number().over(l3.orderBy("_h"))})
    head = F.col("r2") == 1
    pairs = pairs.withColumn("one", head & (F.sum(head.cast("int")).over(every) <= size)).withColumn("open", (F.col("r3") == 1) & ~F.max("one").over(l3))
    rank = F.row_number().over(every.orderBy(F.desc("open"), "n3", F.col("l3").asc_nulls_first()))
    pairs = pairs.withColumn("two", F.col("open") & (rank <= size - F.sum(F.col("one").cast("int")).over(every)))
    pairs = pairs.withColumn("phase", F.when(F.col("one"), 1).when(F.col("two"), 2))
    # Of what is left, each l2 has its share; the largest takes what rounding leaves, and the smallest give back what it takes too much.
    left = F.lit(size) - F.count("phase").over(every)
    pairs = pairs.withColumn("_left", left).withColumn("_t", F.when(head, F.rint(F.col("_left") * F.col("n2") / F.sum("n").over(every)).cast("bigint")))
    pairs = pairs.withColumn("_off", F.sum("_t").over(every) - F.col("_left"))
    largest = F.row_number().over(every.orderBy(F.desc(head), F.desc("n2"), "l2")) == 1
    pairs = pairs.withColumn("_t", F.col("_t") + F.when(largest, F.greatest(-F.col("_off"), F.lit(0))).otherwise(0))
    before = F.coalesce(F.sum("_t").over(every.orderBy(F.col("_t").asc_nulls_last(), "l2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = pairs.withColumn("_quota", F.col("_t") - F.least(F.col("_t"), F.greatest(F.lit(0), F.col("_off") - before)))
    heads = rows.withColumn("r", F.row_number().over(l2.orderBy("_h"))).filter(F.col("r") <= 2 * size)
    shown = ("l2", "_h", "_row", "phase", "_quota")
    few = pairs.select(*shown).unionByName(heads.select("l2", "_h", "_row", F.lit(None).cast("int").alias("phase"), F.lit(None).cast("bigint").alias("_quota")))
    few = few.withColumn("_quota", F.max("_quota").over(l2)).withColumn("_once", F.row_number().over(Window.partitionBy("l2", "_h").orderBy(F.col("phase").asc_nulls_last()))).filter("_once = 1")
    few = few.withColumn("_free", F.row_number().over(l2.orderBy(F.col("phase").isNotNull(), "_h")))
    few = few.withColumn("phase", F.when(F.col("phase").isNull() & (F.col("_free") <= F.col("_quota")), 3).otherwise(F.col("phase")))
    few = few.withColumn("_rest", F.row_number().over(every.orderBy(F.col("phase").isNotNull(), "_h"))).withColumn("_missing", F.lit(size) - F.count("phase").over(every))
    few = few.withColumn("phase", F.when(F.col("phase").isNull() & (F.col("_rest") <= F.col("_missing")), 4).otherwise(F.col("phase")))
    return few.filter("phase is not null").select("_row.*", "phase")
