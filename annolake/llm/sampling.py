"""Sample matching target category proportions (problem 5): systematic sampling with unequal probabilities.

Rows stand in random order within sorted categories. A category's rows have the chance to be drawn that its weight asks for, scaled so that all chances add up to the
size of the sample: no chance passes 1, no category falls below its floor, and what absent and short categories lack is spread over the others by their weights. A running
sum of the chances goes over all rows; from one random start, a row is drawn wherever the sum passes a whole number. A category so gets its expected number of rows, rounded
up or down, and floors, which are whole numbers, hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.operators.ranks import BITS, BUCKETS
from annolake.operators.splits import order_hash


def _start(seed: int) -> float:
    """The random start, in [0, 1)."""
    return (seed * 2654435761 % 2**32) / 2**32


def plan(counts: DataFrame, targets: DataFrame, size: int, floor: int, seed: int) -> DataFrame:
    """One row per category of counts (category, available) or targets (category, weight): expected rows, where its part of the running sum begins, and rows drawn.

    Expected is scale x weight, but at least the floor and at most what is available. Their sum over the categories grows with the scale in straight pieces, whose ends are where a
    category leaves its floor or is used up; the scale lies in the piece where the sum reaches the size of the sample. Categories are few (a row each), so running sums over them go through one task.
    """
    both = counts.join(targets.groupBy("category").agg(F.sum("weight").alias("weight")), "category", "full").fillna(0, ["available", "weight"])
    wanted = F.col("weight") > 0
    both = both.withColumn("least", F.when(wanted, F.least(F.lit(floor), F.col("available"))).otherwise(F.lit(0)).cast("double"))
    end = lambda at, sign: F.struct(F.when(wanted, at / F.col("weight")).otherwise(0.0).alias("at"), F.when(wanted, sign * F.col("weight")).otherwise(0.0).alias("slope"))
    ends = both.select("*", F.posexplode(F.array(end(F.col("least"), 1.0), end(F.col("available"), -1.0))).alias("kind", "end")).select("*", "end.*").drop("end")
    every, order = Window.partitionBy(), Window.partitionBy().orderBy("at", "kind", "category")
    ends = ends.withColumn("steep", F.sum("slope").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("gain", F.coalesce(F.lag("steep").over(order) * (F.col("at") - F.lag("at").over(order)), F.lit(0.0)))
    first = F.col("kind") == 0
    ends = ends.withColumn("reached", F.sum(F.when(first, F.col("least"))).over(every) + F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    goal = F.least(F.lit(float(size)), F.sum(F.when(first & wanted, F.col("available"))).over(every).cast("double"))
    piece = F.max(F.when((F.col("reached") <= F.col("goal")) | (F.col("place") == 1), F.struct("place", "at", "reached", "steep"))).over(every)
    ends = ends.withColumn("goal", goal).withColumn("piece", piece)
    scale = F.col("piece.at") + F.when(F.col("piece.steep") > 1e-9, F.greatest(F.col("goal") - F.col("piece.reached"), F.lit(0.0)) / F.col("piece.steep")).otherwise(0.0)
    known = ends.filter(first).withColumn("free", scale * F.col("weight"))
    known = known.withColumn("expected", F.when(wanted, F.least(F.greatest("free", "least"), F.col("available").cast("double"))).otherwise(0.0))
    running = Window.partitionBy().orderBy("category")
    upto = F.round(F.sum("expected").over(running), 9) + _start(seed)
    before = F.round(F.coalesce(F.sum("expected").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 9) + _start(seed)
    known = known.withColumns({"begin": before, "end": upto})
    return known.select("category", "available", "weight", "least", "free", "expected", "begin", (F.floor("end") - F.floor("begin")).cast("bigint").alias("drawn"))


def report(known: DataFrame, size: int) -> DataFrame:
    """Per category of a plan: target share and rows wanted, rows drawn and their share of the sample, and a status.

    met: the share is the target's, to less than a row; short: used up, and still below it; absent: wanted, but none available; floor: raised to the floor; above: it took
    over what other categories lack; below: it gave up rows for floors; untargeted: no weight.
    """
    every = Window.partitionBy()
    kept, all_ = F.col("kept"), F.sum("drawn").over(every)
    df = known.withColumn("target", F.when(F.sum("weight").over(every) > 0, F.col("weight") / F.sum("weight").over(every)).otherwise(0.0)).withColumn("kept", F.col("drawn")).withColumn("_all", all_)
    off = kept - F.col("target") * F.col("_all")
    status = (
        F.when(F.col("weight") <= 0, "untargeted").when(F.col("available") == 0, "absent").when((kept == F.col("available")) & (off <= -1), "short").when((F.col("free") < F.col("least")) & (kept == F.col("least")), "floor")
        .when(F.abs(off) < 1, "met").when(off > 0, "above").otherwise("below")
    )
    share = F.when(F.col("_all") > 0, kept / F.col("_all")).otherwise(0.0)
    return df.select("category", "available", "weight", F.round("target", 6).alias("target_share"), F.round(F.col("target") * size, 6).alias("wanted"), "kept", F.round(share, 6).alias("share"), status.alias("status"))


def proportional_sample(rows: DataFrame, key: str, category: Column, targets: DataFrame, size: int, floor: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: `size` rows, or all that have a target if these are fewer, with columns drawn_as (the category) and drawn_rank; report: see report().

    rows: key unique, else its copies are told apart by nothing but chance; category null counts as ''. targets: (category, weight), weights of a category that
    occurs twice add up, null and negative ones count as none. Categories without a target get nothing. Floors hold even where they add up to more than the size.
    Empty tables give an empty sample, and a report of the targets.

    Ranks are needed only where a whole number is passed: the hash that orders the rows is cut into buckets, which are counted, and only rows of buckets with a row to draw, no
    more of them than the sample has rows, are shuffled and ranked.
    """
    buckets = BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(F.struct(*rows.columns).alias("_row"), F.col(key).alias("_key"), F.coalesce(category, F.lit("")).alias("category"))
    named = named.withColumn("_order", F.coalesce(order_hash(seed, "_key"), F.lit(0))).withColumn("_bucket", F.shiftright("_order", BITS - max(0, buckets - 1).bit_length()))
    held = named.groupBy("category", "_bucket").agg(F.count("*").alias("_n"))
    clean = targets.select("category", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")).filter("category is not null")
    known = plan(held.groupBy("category").agg(F.sum("_n").alias("available")), clean, size, floor, seed)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("category").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    up = lambda k: F.floor(F.round(F.col("begin") + k * (F.col("expected") / F.col("available")), 9))
    offsets = held.withColumn("_before", before).join(known.filter("drawn > 0").select("category", "available", "expected", "begin"), "category")
    hit = offsets.filter(up(F.col("_before") + F.col("_n")) > up(F.col("_before"))).drop("_n")
    ranked = named.join(F.broadcast(hit), ["category", "_bucket"]).withColumn("_own", F.row_number().over(Window.partitionBy("category", "_bucket").orderBy("_order", "_key")))
    rank = F.col("_before") + F.col("_own")
    chosen = ranked.filter(up(rank) > up(rank - 1))
    return chosen.select("_row.*", F.col("category").alias("drawn_as"), rank.alias("drawn_rank")), report(known, size)
