"""Choosing rows: first or last per key, differences and overlaps of id sets, numbering, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: list[str], order: Column, last: bool = False) -> DataFrame:
    """The row of each key with the least (or, if last, the greatest) `order`, which tells the rows of a key apart.

    Rows are folded before the shuffle, so that a key of any size is no burden. A null key is a key.
    """
    pick = F.max_by if last else F.min_by
    whole = F.struct(*df.columns)
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(pick(whole, order).alias("_row")).select("_row.*")


def without(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among others'; rows without a key stay."""
    return df.join(others.select(key).filter(F.coalesce(F.col(key), F.lit("")) != "").distinct(), key, "left_anti").select(df.columns)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have, each once: a leak, where the sides must be apart."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str, on_insert: tuple[str, ...] = ()) -> DataFrame:
    """current with the newest row of each key among both; order tells the rows of a key apart. Columns on_insert keep what the oldest row of the key has, as they are set once."""
    both = current.unionByName(changes)
    if not on_insert:
        return one_per_key(both, [key], F.col(order), last=True)
    first = F.struct(*on_insert)
    kept = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("_row"), F.min_by(first, F.col(order)).alias("_first"))
    return kept.select(*(F.col(f"_first.{c}" if c in on_insert else f"_row.{c}").alias(c) for c in both.columns))


def offset_rows(df: DataFrame, order: str, offset: int, limit: int | None = None) -> DataFrame:
    """Rows of df from `offset` on, of which order counts them from 0, `limit` at most. An offset that is negative, or not below the number of rows, is an error when rows are read; so is one into an empty table."""
    rows = df.agg(F.count("*").alias("n")).scalar()
    if offset < 0:
        raise ValueError(f"offset {offset} is negative")
    begin = F.when(rows > offset, F.lit(offset)).otherwise(F.raise_error(F.concat(F.lit(f"offset {offset} is out of range: rows "), rows.cast("string"))).cast("int"))
    kept = df.filter(F.col(order) >= begin)
    return kept if limit is None else kept.filter(F.col(order) < offset + limit)


def only_approved(df: DataFrame, status: str, approved: str) -> DataFrame:
    """Rows whose status is `approved`, if any row has a status; all rows, if none has."""
    any_ = df.agg(F.coalesce(F.max(F.coalesce(F.col(status), F.lit("")) != ""), F.lit(False)).alias("any")).scalar()
    return df.filter(~any_ | (F.coalesce(F.col(status), F.lit("")) == approved))


def updated(df: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """df with the columns changed in rows where the condition holds; null is no. What a dry run counts are the rows where it holds."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with the place, from 0, of each row in its group by the unique column `order`.

    The group's rows are ranked within ranges of `order`, and the ranges' counts are summed up, so that no group goes through one task.
    """
    spread = df.withColumn("_range", F.floor(F.col(order) / 10_000))
    counts = spread.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1
    joined = spread.withColumn("_own", own).join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)


def batches(df: DataFrame, order: str, workers: int, name: str) -> DataFrame:
    """df with a batch number: as many consecutive rows (order counts them from 0) as there are rows, div workers, + 1."""
    size = F.floor(df.agg(F.count("*").alias("n")).scalar() / workers) + 1
    return df.withColumn(name, F.floor(F.col(order) / size))
