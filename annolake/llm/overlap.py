"""Same or near-same records across splits (problem 2): an exact prefix-filter join of two sides on rare shingles.

Two texts are the same if at most `most` words of the longer are added, dropped, altered or moved; case, accents, marks and blanks do not matter.
Shingles are of one word here, as an edit then changes one shingle of a text and a move none. Ordered by rarity, each of two such texts has at most `most` words that
the other lacks before the first word that they share, and before the second one. So the evaluation side's most + 2 rarest words are the index, and training texts
probe it with theirs: with single words where they are rare, and with pairs of them where they are not, which keeps lists short. Both sides are joined on these keys,
keys that hold a large share of the training side in slices. Candidates are ruled out within the join by length, by the places of what they share in the order of
rarity, and by a signature of their words; the longest common subsequence verifies the others.

Texts that occur more than once are one class on either side: pairs are found between classes.

Joins are hinted to merge: Spark plans sizes from the compressed files that rows are read from, and keys or texts made of them take up to some hundred times that, so
that a side which counts as small enough to broadcast may fill the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.text import spaced_words
from annolake.operators.rarity import SIGNATURE, by_rarity, lacking, shares
from annolake.operators.skew import hot_join, spread_join
from annolake.session import stored

#: A word that stands in a greater share of the texts is a key in pairs only.
RARE = 0.02


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, with a bit for each word of a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = left = (1 << len(a)) - 1
    for w in b:
        hit = left & at.get(w, 0)
        left = (left + hit | left - hit) & full
    return len(a) - left.bit_count()


def allowed(longer: int, most: int, share: float) -> int:
    """Words by which two texts may differ, of which the longer has so many: at most `most`, and more than `share` of the longer stays."""
    return min(most, -int(-longer * (1 - share) // 1) - 1)


def same(a: list[str], b: list[str], most: int, share: float = 0.0) -> bool:
    """Whether two texts with words are the same but for the words allowed."""
    longer = max(len(a), len(b))
    may = allowed(longer, most, share)
    return abs(len(a) - len(b)) <= may and longer - common(a, b) <= may


def keyed(df: DataFrame) -> DataFrame:
    """Rows (id, key, text) of rows (id, text): the text's words, and their MD5 as the key of its class. Rows without an id, and texts without a word, are left out. Written once, as it is read for each step."""
    held = df.filter(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), spaced_words(F.col("text")).alias("text")).filter("text <> ''")
    return stored(held.select("id", F.unhex(F.md5("text")).alias("key"), "text"), "texts")


def classes(rows: DataFrame) -> DataFrame:
    """Classes (key, text, class, n) of keyed rows: the n rows whose texts have the same words; class is their least id."""
    each = rows.groupBy("text").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    return stored(each.select(F.unhex(F.md5("text")).alias("key"), "text", "class", "n"), "classes")


def members(rows: DataFrame, each: DataFrame) -> DataFrame:
    """Rows (id, class) of keyed rows and their classes; large classes are spread."""
    return hot_join(rows.select("id", "key"), each.select("key", "class", "n"), ["key"], "n", "id", merge=True).select("id", "class")


def _sets(each: DataFrame) -> DataFrame:
    """The texts as sets of hashes of words, with their number of words and a signature of 128 bits."""
    split = F.split("text", " ")
    held = each.select("class", F.size(split).alias("size"), F.array_distinct(F.transform(split, lambda w: F.xxhash64(w))).alias("tokens"))
    return held.withColumns(dict(zip(("low", "high"), map(F.expr, SIGNATURE))))


def _postings(sets: DataFrame, table: Column, most: int, index: bool) -> DataFrame:
    """A row per key of the rarest words: what the filters need to know of the text, and the key's places in the order of rarity.

    No key stands in a greater share of the texts than its rarest word, which both sides know. It is cut into slices of RARE; the index has a row in each.
    """
    ordered = by_rarity(sets, table, F.lit(most + 2)).select("class", "size", "low", "high", F.size("tokens").alias("different"), F.col("ordered").alias("p"))
    few = F.col("different") - most < 2  # may share one word only

    def keys(x: Column, i: Column) -> Column:
        slices = F.greatest(F.ceil(x.share / RARE), F.lit(1)).cast("int").alias("slices")
        single = F.when((i <= most) & ((x.share <= RARE) | few), F.array(F.struct(x.token.alias("key"), i.alias("i"), i.alias("j"), slices)))
        pairs = F.when((i <= most) & (x.share > RARE), F.transform(F.slice("p", i + 2, most + 2), lambda y, j: F.struct(F.xxhash64(x.token, y.token).alias("key"), i.alias("i"), (i + 1 + j).alias("j"), slices)))
        none = F.array().cast("array<struct<key: bigint, i: int, j: int, slices: int>>")
        return F.concat(F.coalesce(single, none), F.coalesce(pairs, none))

    rows = ordered.select("class", "size", "low", "high", "different", F.explode_outer(F.flatten(F.transform("p", keys))).alias("k")).select("class", "size", "low", "high", "different", "k.*")
    place = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)) if index else F.pmod(F.xxhash64("class"), F.col("slices")).cast("int")
    # Few and short columns, as each text has many such rows.
    facts = F.shiftleft(F.col("size").cast("bigint"), 40).bitwiseOR(F.shiftleft(F.col("different").cast("bigint"), 16)).bitwiseOR(F.col("i") * 256 + F.col("j"))
    return rows.withColumn("slice", place).select(F.xxhash64("key", "slice").alias("key"), "class", "low", "high", facts.alias("facts"))


def _verified(most: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [same(x.split(" "), y.split(" "), most, share) for x, y in zip(b.column("text").to_pylist(), b.column("other_text").to_pylist())]
            yield b.select(["class", "other"]).filter(pa.array(good, pa.bool_()))

    return run


def same_classes(left: DataFrame, right: DataFrame, most: int, share: float = 0.0) -> DataFrame:
    """Pairs (class, other) of classes (class, text) of both sides whose texts are the same but for `most` words of the longer, of which more than `share` must stay.

    most is 250 at most, and texts have fewer than 8 million words. With share 0, two texts of `most` words or fewer need have one word in common. Empty tables give no pairs.
    """
    sets = [_sets(left), _sets(right)]
    table = shares(sets)
    a, b = (_postings(s, table, most, index) for s, index in zip(sets, (True, False)))
    joined = a.withColumnsRenamed({c: f"a_{c}" for c in a.columns if c != "key"}).join(b.withColumnsRenamed({c: f"b_{c}" for c in b.columns if c != "key"}).hint("merge"), "key")
    fact = lambda s, shift, bits: F.shiftright(f"{s}_facts", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    joined = joined.withColumns({f"{s}_{name}": fact(s, shift, bits) for s in "ab" for name, shift, bits in (("size", 40, 23), ("different", 16, 24), ("i", 8, 8), ("j", 0, 8))})
    longer = F.greatest("a_size", "b_size")
    may = F.least(F.lit(most), F.ceil(longer * F.lit(1 - share)).cast("int") - 1)
    # What one text has and the other lacks: before the first place, between the places, behind the second.
    spans = [(F.col(f"{s}_i"), F.greatest(F.col(f"{s}_j") - F.col(f"{s}_i") - 1, F.lit(0)), F.col(f"{s}_different") - F.col(f"{s}_j")) for s in "ab"]
    lacks = lambda x, y: sum((F.greatest(p - q, F.lit(0)) for p, q in zip(x, y)), F.lit(0))
    marks = lambda x, y: lacking((f"{x}_low", f"{x}_high"), (f"{y}_low", f"{y}_high"))
    close = joined.filter((F.abs(F.col("a_size") - F.col("b_size")) <= may) & (marks("a", "b") <= may) & (marks("b", "a") <= may) & (lacks(*spans) <= may) & (lacks(*spans[::-1]) <= may))
    pairs = close.select(F.col("a_class").alias("class"), F.col("b_class").alias("other")).distinct()
    texts = pairs.join(left.select("class", "text").hint("merge"), "class").join(right.select(F.col("class").alias("other"), F.col("text").alias("other_text")).hint("merge"), "other")
    return texts.select("class", "other", "text", "other_text").mapInArrow(_verified(most, share), "class bigint, other bigint")


def near_same(evaluation: DataFrame, training: DataFrame, most: int, share: float = 0.0) -> DataFrame:
    """Pairs (id, other_id) of rows (id, text) of both sides whose texts are the same but for `most` words, as same_classes() tells.

    Texts without a word, null texts and null ids have no partner. Repeated rows give repeated pairs; rows of one text are one class until the end, and rows of
    large classes are spread. Empty tables give no pairs.
    """
    rows, others = keyed(evaluation), keyed(training)
    left, right = classes(rows), classes(others)
    pairs = stored(same_classes(left, right, most, share), "pairs")
    half = spread_join(pairs, members(rows, left), ["class"], "id", merge=True).select("id", F.col("other").alias("class"))
    return spread_join(half, members(others, right).withColumnRenamed("id", "other_id"), ["class"], "other_id", merge=True).select("id", "other_id")
