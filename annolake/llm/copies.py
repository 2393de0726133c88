"""Duplicates hidden by formatting differences (problem 6).

Records are copies when the letters (with accents) and digits of each of their fields are the same in the same order, ignoring case.
The characters of a batch run through a skip-and-fold table into two polynomial hashes for each field; no canonical text is made. Rows whose
hashes agree are then compared with the first row of their group by two pointers that skip what does not count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.operators.skew import hot_join
from annolake.session import cut_lineage

#: Code points beyond these planes (rare ideographs) count as themselves.
PLANES = 0x20000
#: Characters of one pass over a batch; it bounds the memory that long texts take.
PASS = 1 << 21
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


class _Fold(dict):
    """Character -> its letters, digits and marks in lower case, decomposed; empty for what is skipped."""

    def __missing__(self, char: str) -> str:
        form = unicodedata.normalize("NFD", char.lower())
        self[char] = kept = "".join(c for c in form if c.isalnum() or unicodedata.combining(c))
        return kept


FOLD = _Fold()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each number."""
    x = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its value in either hash (the sum over its letter and marks, so that composed and decomposed letters agree), and its kind: 0 skipped, 1 letter or digit, 2 mark."""
    values = np.zeros((2, PLANES), dtype=np.uint64)
    kind = np.zeros(PLANES, dtype=np.uint8)
    for cp in range(PLANES):
        if 0xD800 <= cp < 0xE000:
            continue
        kept = FOLD[chr(cp)]
        if kept:
            kind[cp] = 2 if unicodedata.combining(kept[0]) else 1
            parts = np.array([ord(c) for c in kept], dtype=np.uint64)
            for h in (0, 1):
                values[h, cp] = _mixed(parts * np.uint64(2) + np.uint64(h)).sum(dtype=np.uint64)
    FOLD.clear()
    return values[0], values[1], kind


def _hash_texts(texts: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each text, as an array of 2 x n."""
    first, second, kinds = _tables()
    out = np.zeros((2, len(texts)), dtype=np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    known = codes < PLANES
    kind = np.where(known, kinds[np.where(known, codes, 0)], 1)
    kept = kind > 0
    codes, row, kind, known = codes[kept], row[kept], kind[kept], known[kept]
    if not len(codes):
        return out
    starts = np.flatnonzero((kind == 1) | np.r_[True, row[1:] != row[:-1]])
    row = row[starts]
    rows_at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(rows_at, np.diff(np.r_[rows_at, len(row)]))
    for h, table in enumerate((first, second)):
        value = np.where(known, table[np.where(known, codes, 0)], _mixed(codes.astype(np.uint64) * np.uint64(2) + np.uint64(h)))
        unit = np.add.reduceat(value, starts)
        power = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), BASES[h], dtype=np.uint64)], dtype=np.uint64)
        out[h, row[rows_at]] = np.add.reduceat(unit * power[place], rows_at)
    return out


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most PASS characters, or of one row."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > PASS:
            yield begin, i
            begin, total = i, 0
        total += n
    yield begin, len(lengths)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("fields")
        sizes = np.diff(lists.offsets.to_numpy())
        texts = [t or "" for t in lists.flatten().to_pylist()]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        each = np.concatenate([_hash_texts(texts[i:j]) for i, j in _slices(lengths)], axis=1) if texts else np.zeros((2, 0), np.uint64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = []
        for h in (0, 1):  # the place of a field is part of its value
            own = _mixed(each[h] + _mixed(place + 1))
            total = np.zeros(len(sizes), np.uint64)
            np.add.at(total, row, own)
            keys.append(pa.array(total.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("src"), b.column("id"), *keys, lists], ["src", "id", "h1", "h2", "fields"])


def _stream(text: str | None) -> Iterator[str]:
    """What counts of a text, one after the other, skipping the rest."""
    text = text or ""
    if not unicodedata.is_normalized("NFC", text):  # marks in one order
        text = unicodedata.normalize("NFC", text)
    return (c for char in text for c in FOLD[char])


def same(a: list[str | None], b: list[str | None]) -> bool:
    """Whether two records are copies, by two pointers over each field."""
    return a == b or len(a) == len(b) and all(x == y or all(p == q for p, q in zip_longest(_stream(x), _stream(y))) for x, y in zip(a, b))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """other is empty for a true copy; for the others, whose hashes agree by chance, it is what counts of the record."""
    for b in batches:
        pairs = zip(b.column("fields").to_pylist(), b.column("first_fields").to_pylist())
        other = ["" if same(x, y) else "\x1e" + "\x1f".join("".join(_stream(t)) for t in x) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("src", "id", "h1", "h2", "first_id")), pa.array(other, pa.string())], ["src", "id", "h1", "h2", "first_id", "other"])


def copies(rows: DataFrame) -> DataFrame:
    """Rows (src, first_id, copy_id): one for each row of rows (src string, id bigint, fields array<string>) that has an earlier copy.

    first_id is the smallest id of the group, which is of one src. Null fields equal empty ones; records without any letter or digit are copies
    of each other; ids that occur twice are told apart only if they differ. Empty tables give no rows.
    Hashes are counted before the shuffle, and rows of hot groups are spread.
    """
    hashed = rows.mapInArrow(_hashes, "src string, id bigint, h1 bigint, h2 bigint, fields array<string>")
    key = ["src", "h1", "h2"]
    groups = hashed.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    groups = cut_lineage(groups)
    members = cut_lineage(hot_join(hashed, groups, key, "n", "id"))
    firsts = members.filter("id = first_id").select(*key, "first_id", "n", F.col("fields").alias("first_fields"))
    pairs = hot_join(members.filter("id > first_id").drop("n"), firsts, [*key, "first_id"], "n", "id")
    checked = cut_lineage(pairs.mapInArrow(_verified, "src string, id bigint, h1 bigint, h2 bigint, first_id bigint, other string"))
    chance = checked.filter("other <> ''")
    regrouped = chance.join(chance.groupBy(*key, "other").agg(F.min("id").alias("first")), [*key, "other"]).filter("id > first").select("src", F.col("first").alias("first_id"), "id")
    return checked.filter("other = ''").select("src", "first_id", "id").unionByName(regrouped).withColumnRenamed("id", "copy_id")
