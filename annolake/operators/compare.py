"""Differences between two copies of a dataset (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Column, fields: dict[str, Column], newest: Sequence[str]) -> DataFrame:
    """One row per key: the fields of the row with the greatest values of the columns `newest`, null below all.

    The rows of a key are folded before the shuffle, so that a key that holds a third of all rows moves one row per task.
    Rows whose key is null or empty are left out. Ties in all of `newest` go to the row with the greater fields.
    """
    picked = df.select(key.alias("key"), F.struct(*newest).alias("at"), F.struct(*(c.alias(f) for f, c in fields.items())).alias("row"))
    return picked.filter(F.coalesce(F.col("key"), F.lit("")) != "").groupBy("key").agg(F.max(F.struct("at", "row")).alias("top")).select("key", "top.row.*")


def hashed(c: Column) -> Column:
    """A hash of 64 bits that stands for a value where it is only compared; null stays null. Two values are taken for one with a chance of 2^-64."""
    return F.when(c.isNotNull(), F.xxhash64(c))


def _column(table: pa.Table, name: str, order: np.ndarray) -> pa.Array:
    return table.column(name).combine_chunks().take(pa.array(order))


def _differs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """True where the values differ; null equals null only."""
    unequal = pc.fill_null(pc.not_equal(left, right), False)
    one_null = pc.xor(pc.is_null(left), pc.is_null(right))
    return pc.or_(unequal, one_null).to_numpy(zero_copy_only=False)


def diff(left: DataFrame, right: DataFrame, fields: Sequence[str], names: tuple[str, str], carried: str | None = None) -> DataFrame:
    """What differs between two tables (key, *fields) with unique keys, as rows (key, finding, left_value, right_value).

    finding is `missing_in_<name>` or a field whose values differ; null equals null only, so make fields comparable first. Fields are of one type, that of the values, or are compared as text; give
    hashes of wide fields, and look values up for the findings only. carried: a column of both tables, whose values come too, as left_ and right_ and its name.
    Both sides are cogrouped by hash bucket; in each, sorted keys are aligned by binary search and the columns compared by masks. There are four buckets for a shuffle partition.
    An empty side gives a missing row for each key of the other; two empty sides give no rows.
    """
    kinds = {df.schema[f].dataType.simpleString() for df in (left, right) for f in fields}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    bucket = F.pmod(F.xxhash64("key"), F.lit(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("bucket")
    shape = [F.col(f).cast(kind).alias(f) for f in fields]
    more = [(f"{side}_{carried}", df.schema[carried].dataType.simpleString()) for side, df in (("left", left), ("right", right))] if carried else []
    extra = [F.col(carried)] if carried else []

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        codes = pa.chunked_array([*a.column("key").chunks, *b.column("key").chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
        ka, kb = codes[: len(a)], codes[len(a) :]  # equal keys have equal numbers
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka, kb = ka[oa], kb[ob]
        at = np.searchsorted(kb, ka)
        both = at < len(kb)
        both[both] = kb[at[both]] == ka[both]
        there = np.zeros(len(kb), dtype=bool)
        there[at[both]] = True
        ia, ib, only_a, only_b = oa[both], ob[at[both]], oa[~both], ob[~there]
        values = a.schema.field(fields[0]).type

        def rows(keys: pa.Array, what: str, va: pa.Array | None, vb: pa.Array | None, ca: np.ndarray | None, cb: np.ndarray | None) -> list[pa.Array]:
            n = len(keys)
            out = [keys, pa.array([what] * n, pa.string()), pa.nulls(n, values) if va is None else va, pa.nulls(n, values) if vb is None else vb]
            for table, order in ((a, ca), (b, cb)) if carried else ():
                out.append(pa.nulls(n, table.schema.field(carried).type) if order is None else _column(table, carried, order))
            return out

        parts = [rows(_column(a, "key", only_a), f"missing_in_{names[1]}", None, None, only_a, None), rows(_column(b, "key", only_b), f"missing_in_{names[0]}", None, None, None, only_b)]
        for field in fields:
            va, vb = _column(a, field, ia), _column(b, field, ib)
            mask = _differs(va, vb)
            cells = pa.array(mask)
            parts.append(rows(_column(a, "key", ia[mask]), field, va.filter(cells), vb.filter(cells), ia[mask], ib[mask]))
        columns = ["key", "finding", "left_value", "right_value", *(n for n, _ in more)]
        return pa.concat_tables([pa.Table.from_arrays(p, names=columns) for p in parts])

    one, other = (df.select(bucket, "key", *shape, *extra).groupBy("bucket") for df in (left, right))
    schema = ", ".join(["key string", "finding string", f"left_value {kind}", f"right_value {kind}", *(f"`{n}` {k}" for n, k in more)])
    return one.cogroup(other).applyInArrow(compare, schema)
