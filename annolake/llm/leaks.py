"""Evaluation texts leaking into training text (problem 9): a distributed positional inverted index.

Terms are pairs of neighbouring words (a next-word index), as single words stand in nearly every document; a run of n words is a run of n - 1 terms. The postings
(term, document, place) of the terms that evaluation texts have are written once as a table in the shared folder; how often each term occurs is counted from it. Of each run of
terms of an evaluation text, the rarest one is joined with its postings, which gives places where the text may begin (diagonals). The postings of the other terms around it,
shifted by their offsets, are intersected with these places, and consecutive hits of a diagonal are runs. Nothing goes through the driver; a term's postings are cut into slices.

Terms and postings are told apart by hashes of 64 bits: one is taken for another with a chance of 2^-64, and a passage only if that befalls it within an otherwise equal run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.functions.text import words
from annolake.session import stored

#: Slices of a term's postings; the evaluation side of the join is repeated in each.
SLICES = 16


#: Bits of a term that its neighbours' postings keep.
MARK = 0xFFFF


def _terms(df: DataFrame, name: str, place: str) -> DataFrame:
    """A row (name, place, term, before, after) for each pair of neighbouring words of rows (id, text), with marks of the terms next to it; places start at 0."""
    held = df.filter("id is not null and text is not null").select(F.col("id").cast("bigint").alias(name), words(F.col("text")).alias("w"))
    pairs = held.select(name, F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda x, y: F.xxhash64(x, y)).alias("p"))
    mark = lambda i: F.coalesce(F.get("p", i).bitwiseAND(F.lit(MARK)).cast("int"), F.lit(-1))
    each = F.transform("p", lambda t, i: F.struct(t.alias("term"), mark(i - 1).alias("before"), mark(i + 1).alias("after")))
    return pairs.select(name, F.posexplode_outer(each).alias(place, "t")).filter("t is not null").select(name, place, "t.*")


def _slice() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int")


def _runs(hits: DataFrame, seed: int) -> DataFrame:
    """Runs (doc_id, item_id, a, d, n) of hits (doc_id, item_id, diagonal, j): place in the item, place in the document and words of each run of `seed` words or more, as long as the hits go."""
    on = ["doc_id", "item_id", "diagonal"]
    island = F.col("j") - F.row_number().over(Window.partitionBy(*on).orderBy("j"))
    runs = hits.withColumn("island", island).groupBy(*on, "island").agg(F.min("j").alias("a"), (F.count("*") + 1).alias("n")).filter(F.col("n") >= seed)
    return runs.select("doc_id", "item_id", "a", (F.col("diagonal") + F.col("a")).alias("d"), "n")


def passages(documents: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """Runs (doc_id, item_id, a, d, n) of `seed` words or more that documents (id, text) share with items (id, text), each as long as it goes.

    Every term of such a run stands in a window of seed - 1 terms within the run, so that intersecting the terms around the rarest one of each window finds the whole run.
    """
    own = _terms(items, "item_id", "j").distinct()  # an item that is there twice counts once
    held = _terms(documents, "doc_id", "pos").join(own.select("term").distinct(), "term", "left_semi")
    postings = stored(held.select("term", "doc_id", "pos", "before", "after"), "postings")
    frequency = postings.groupBy("term").agg(F.count("*").alias("frequency"))
    known = own.join(frequency, "term", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    span = Window.partitionBy("item_id").orderBy("j").rangeBetween(0, seed - 2)
    windows = known.select("item_id", F.col("j").alias("begin"), F.min(F.struct("frequency", "term", "j", "before", "after")).over(span).alias("rarest"), F.count("*").over(span).alias("terms"))
    windows = windows.filter((F.col("terms") == seed - 1) & (F.col("rarest.frequency") > 0)).select("item_id", "rarest.*", "begin")
    # The terms next to the rarest one stand in the document too, where they are in the run.
    none = F.lit(None).cast("int")
    behind = F.when(F.col("j") > F.col("begin"), F.col("before")).otherwise(none).alias("item_before")
    ahead = F.when(F.col("j") < F.col("begin") + seed - 2, F.col("after")).otherwise(none).alias("item_after")
    anchors = stored(windows.select("item_id", "term", "j", behind, ahead).distinct(), "anchors")
    spread = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    found = postings.withColumn("slice", _slice()).join(spread, ["term", "slice"])
    found = found.filter(F.coalesce(F.col("before") == F.col("item_before"), F.lit(True)) & F.coalesce(F.col("after") == F.col("item_after"), F.lit(True)))
    places = found.select("doc_id", "item_id", (F.col("pos") - F.col("j")).alias("diagonal"), F.col("j").alias("at"))
    around = own.select("item_id", "term", "j").join(anchors.select("item_id", F.col("j").alias("at")).distinct(), "item_id").filter(F.abs(F.col("j") - F.col("at")) <= seed - 2)
    wanted = places.join(around, ["item_id", "at"]).select("doc_id", "item_id", "diagonal", "j", "term", (F.col("diagonal") + F.col("j")).alias("pos")).distinct()
    # Postings are moved as one number each.
    mark = F.xxhash64("term", "doc_id", "pos").alias("posting")
    hits = wanted.select("doc_id", "item_id", "diagonal", "j", mark).join(postings.select(mark), "posting", "left_semi").drop("posting")
    return _runs(hits, seed)


def chained(pieces: list[tuple[int, int, int]], slack: int) -> int:
    """Most words of pieces (place in the item, place in the document, words) that follow each other in both with at most `slack` other words between."""
    ends: dict[tuple[int, int], int] = {}
    most = 0
    for a, d, n in sorted(pieces):  # what a piece follows begins before it in the item
        top = n + max((ends.get((a - x, d - y), 0) for x in range(slack + 1) for y in range(slack + 1)), default=0)
        ends[a + n, d + n] = max(ends.get((a + n, d + n), 0), top)
        most = max(most, top)
    return most


def _chains(slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [chained([(p["a"], p["d"], p["n"]) for p in own], slack) for own in b.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), b.column("longest"), pa.array(near, pa.int64())], ["doc_id", "item_id", "longest", "near"])

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """Rows (doc_id, item_id): documents (id, text) that hold `least` consecutive words, two or more, of items (id, text).

    Case, accents, marks and blanks do not matter. Null and empty texts, and texts shorter than least, have no matches; rows without an id are left out, and rows of one id are one
    document or item with all their texts; texts are searched whole. Empty tables give no rows.
    """
    return passages(documents, items, least).select("doc_id", "item_id").distinct()


def near_leaks(documents: DataFrame, items: DataFrame, least: int = 12, seed: int = 5, slack: int = 3) -> DataFrame:
    """Rows (doc_id, item_id, longest, near), also for passages with other words between: as leaks(), but runs of `seed` words or more count that follow each other in both texts.

    longest: words of the longest run that both share. near: words of the longest chain of runs with at most `slack` other words between them, at least `least`.
    Runs of a document and an item are put together in one task; they are no more than the item has words, for each time that the document repeats it.
    """
    pieces = passages(documents, items, seed).groupBy("doc_id", "item_id").agg(F.max("n").alias("longest"), F.sum("n").alias("all"), F.collect_list(F.struct("a", "d", "n")).alias("pieces"))
    near = pieces.filter(F.col("all") >= least).select("doc_id", "item_id", "longest", "pieces").mapInArrow(_chains(slack), "doc_id bigint, item_id bigint, longest bigint, near bigint")
    return near.filter(F.col("near") >= least)
