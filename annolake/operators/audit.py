"""Distribution audits: label counts with modal parents, long tails, lengths, histograms, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A class should have so many rows, and no more than so many.
LOW, HIGH = 30, 200


def label_distribution(df: DataFrame, known: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Per l3 of df (l1, l2, l3): rows, modal parents (the least on ties), whether known (l3) has it, and what it lacks or exceeds.

    Rows without l3 don't count. Empty tables give no rows. Partial counts per triple come before the shuffle.
    """
    triples = df.filter(F.coalesce("l3", F.lit("")) != "").groupBy("l3", "l1", "l2").agg(F.count("*").alias("n"))
    parent = lambda c: F.min_by(c, F.struct(-F.col("m"), c))
    modes = [triples.groupBy("l3", c).agg(F.sum("n").alias("m")).groupBy("l3").agg(parent(c).alias(c)) for c in ("l1", "l2")]
    counts = triples.groupBy("l3").agg(F.sum("n").alias("count"))
    joined = counts.join(modes[0], "l3").join(modes[1], "l3").join(known.select("l3").distinct().withColumn("in_taxonomy", F.lit(True)), "l3", "left")
    n = F.col("count")
    return joined.select(
        "l1", "l2", "l3", "count", F.coalesce("in_taxonomy", F.lit(False)).alias("in_taxonomy"), F.greatest(F.lit(0), low - n).alias("gap"), F.greatest(F.lit(0), n - high).alias("excess"),
        F.when(n >= low, "sufficient").when(n > 0, "needs_augmentation").otherwise("empty").alias("status"),
    )


def long_tail(distribution: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """One row about the class sizes of a label_distribution."""
    n = F.col("count")
    return distribution.agg(
        F.count("*").alias("classes"), F.count_if(n == 1).alias("singletons"), F.count_if(n < low).alias("rare"), F.count_if(n > high).alias("frequent"), F.min(n).alias("least"), F.max(n).alias("most"),
        F.max_by("l3", F.struct(n, "l3")).alias("largest"), F.min_by("l3", F.struct(n, "l3")).alias("smallest"), F.sum("gap").alias("gap"), F.sum("excess").alias("excess"), (F.max(n) / F.min(n)).alias("imbalance"),
    )


def describe(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Per column: count, mean, sample deviation, extremes and exact quartiles, to one digit; nulls don't count."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), c.cast("double").alias("x")) for k, c in columns.items()))).alias("r")).select("r.*")
    one = lambda c, name: F.round(c, 1).alias(name)
    quartiles = [one(F.percentile("x", p), name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return rows.groupBy("field").agg(F.count("x").alias("n"), one(F.avg("x"), "mean"), one(F.stddev_samp("x"), "deviation"), one(F.min("x"), "least"), *quartiles, one(F.max("x"), "most"))


def histogram(df: DataFrame, x: Column, bins: int) -> DataFrame:
    """Rows per bin of equal width between the extremes, the last bin closed; bins without rows are left out."""
    values = df.select(x.cast("double").alias("x")).filter("x is not null")
    ends = values.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("ends")).scalar()
    low, high = F.col("ends.low"), F.col("ends.high")
    at = F.when(high > low, F.least(F.floor((F.col("x") - low) * bins / (high - low)), F.lit(bins - 1))).otherwise(0)
    return values.withColumn("ends", ends).groupBy(at.cast("bigint").alias("bin"), low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Per way of comparing: rows that share their key with another row, keys that recur, and rows that could go. Null keys are of one kind."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()))).alias("r")).select("r.*")
    groups = rows.groupBy("kind", F.md5(F.coalesce("key", F.lit("\x00"))).alias("key")).agg(F.count("*").alias("n"))
    more = F.col("n") > 1
    return groups.groupBy("kind").agg(F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).alias("members"), F.count_if(more).alias("recurring"), F.coalesce(F.sum(F.when(more, F.col("n") - 1)), F.lit(0)).alias("surplus"))


def shares(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows per value and their share of all, in percent to two digits; null is a value. The total is taken over the values, a row each."""
    counts = df.groupBy(by.alias(name)).agg(F.count("*").alias("n"))
    return counts.select(name, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("percent"))
