"""The order of tokens by rarity, for prefix filters.

How many sets hold a token is counted over all sets, in a table of as many numbers as there are hash buckets. Its size does not depend on the data, so that it
reaches every task as the value of a subquery, and no token is shuffled to learn how rare it is. Tokens of one bucket count together, which makes a token less
rare than it is at most: the order is the same for all sets, and a prefix filter needs no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of the table; a power of two.
BUCKETS = 1 << 16


def bucket(token: Column) -> Column:
    """The place in the table of a token, a hash of 64 bits."""
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1


#: A share is held as a level, its logarithm in steps of 1 / STEPS from 2^-FLOOR on, in 18 bits; a token as its last BITS bits beside it, so that one number sorts them.
STEPS, FLOOR, BITS = 4096, 40, 44


def shares(sets: list[DataFrame], tokens: str = "tokens") -> Column:
    """The table: at place k the level of the share of all sets (column tokens, an array of distinct hashes) that hold a token of bucket k."""
    held = reduce(DataFrame.unionByName, (s.select(tokens) for s in sets))
    places = held.select(F.explode(F.concat(F.array(F.lit(0)), F.transform(tokens, bucket))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    every = held.sparkSession.range(BUCKETS + 1).select(F.col("id").cast("int").alias("k")).join(places, "k", "left")
    counts = every.agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"))))["n"].alias("n"))
    level = lambda x: F.greatest(F.ceil((F.log2(F.greatest(x, F.lit(1)) / F.greatest(F.get("n", F.lit(0)), F.lit(1))) + FLOOR) * STEPS), F.lit(0)).cast("bigint")
    return counts.select(F.transform("n", level).alias("shares")).scalar()


def by_rarity(df: DataFrame, table: Column, first: Column, tokens: str = "tokens") -> DataFrame:
    """df with column `ordered`: the `first` rarest tokens as structs (share, token), rarest first; token is the end of the hash, and share is rounded up by less than a thousandth of it.

    Two tokens of one end are one to a join on them, which finds more candidates by that and misses none.
    """
    # The subquery is a column for the analyzer only: the two projections become one.
    packed = F.transform(tokens, lambda t: F.shiftleft(F.get("_shares", bucket(t)), BITS).bitwiseOR(t.bitwiseAND(F.lit((1 << BITS) - 1))))
    ordered = df.withColumn("_shares", table).select(*df.columns, F.slice(F.sort_array(packed), F.lit(1), first).alias("ordered"))
    open_ = lambda x: F.struct(F.pow(F.lit(2.0), F.shiftright(x, BITS) / STEPS - FLOOR).alias("share"), x.bitwiseAND(F.lit((1 << BITS) - 1)).alias("token"))
    return ordered.withColumn("ordered", F.transform("ordered", open_))


#: Two numbers of 64 bits with a bit for each token (a column of hashes): a bit that one set has and the other lacks is a token that the other lacks.
SIGNATURE = tuple(f"aggregate(tokens, 0L, (a, t) -> a | if({x} (t & 4194304) = 0, shiftleft(1L, int(shiftright(t, 16) & 63)), 0L))" for x in ("", "not"))


def lacking(one: tuple[str, str], other: tuple[str, str]) -> Column:
    """How many tokens, at least, the set of the first signature has and the other's lacks."""
    return sum((F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b))) for a, b in zip(one, other)), F.lit(0))
