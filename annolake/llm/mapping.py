"""Mapping free-entered values to a canonical list (problem 7): a set-similarity join with prefix filter.

Tokens of a text are the letters and the letter pairs, with its ends, of its squeezed form (one form of characters, no accents, case, blanks or marks), numbered where they
recur. They are ordered by their rarity over both sides; two sets of a Jaccard similarity of t share a token within short prefixes of this order, so only those are joined.
Lengths, places of the shared token and signatures rule out most pairs within the join; the others are verified exactly, and the best entry is kept. An exact check
follows, as a short text is near to others by chance: a similar text may differ in no more letters than `slips` says.

Both sides are distributed. Each different text is looked up once, and found entries are joined back to the values, large groups of equal values in slices.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.canonical import canonical
from annolake.operators.rarity import SIGNATURE, by_rarity, lacking, shares
from annolake.operators.skew import hot_join
from annolake.session import stored
from annolake.sources.tables import wide

#: A token that stands in a greater share of the texts is joined in slices.
RARE = 0.01
#: Code points that stand for the ends of a text, and for no second letter.
BEGIN, END, NONE = 0x1FFFFE, 0x1FFFFD, 0x1FFFFF


def squeeze(text: str) -> str:
    """Letters and digits of the text's one form, in lower case and without accents."""
    form = unicodedata.normalize("NFD", canonical(text).lower()).replace("đ", "d")
    return "".join(c for c in form if c.isalnum())


def tokens(squeezed: str) -> list[int]:
    """Letters and letter pairs, with the ends as letters of their own and a number for each repetition, as numbers of 63 bits."""
    codes = [BEGIN, *map(ord, squeezed), END]
    seen: Counter = Counter()
    out = []
    for a, b in [*((x, NONE) for x in codes[1:-1]), *zip(codes, codes[1:])]:
        token = a << 42 | b << 21
        out.append(token | seen[token])
        seen[token] += 1
    return out


def slips(letters: int) -> int:
    """Letters in which a text may differ from an entry of so many letters: two of seven, and from ten letters on a fifth, but two at least."""
    return min(2 * letters // 7, max(2, letters // 5))


def edits(a: str, b: str, most: int) -> int:
    """Letters dropped, added, altered or swapped with the next between a and b; most + 1 if there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, earlier[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def segments(text: str) -> list[str]:
    """Runs of words, not across digits, line ends or marks other than hyphens, as squeezed words with blanks between."""
    plain = unicodedata.normalize("NFC", canonical(text))
    found = [" ".join(filter(None, map(squeeze, re.split(r"[ \-]+", s)))) for s in re.findall(r"[^\W\d_]+(?:[ \-]+[^\W\d_]+)*", plain)]
    return list(dict.fromkeys(f for f in found if f))


def _split(longest: dict[str, int]):
    """For mapInArrow: (list, val) to (list, val, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(segments if longest.get(k) else whole)(v) for k, v in zip(b.column("list").to_pylist(), b.column("val").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("list"), b.column("val"), pa.array(parts, pa.list_(pa.string()))], ["list", "val", "parts"])

    return run


def whole(text: str) -> list[str]:
    """The text as the only part that may stand for an entry."""
    return [s] if (s := squeeze(text)) else []


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, ...) with tokens, mixed so that any of their bits can serve as a hash."""
    for b in batches:
        lists = [tokens(s) for s in b.column("part").to_pylist()]
        flat = np.array([x for own in lists for x in own], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        flat = flat ^ (flat >> np.uint64(32))
        offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, "tokens"])


def _sets(df: DataFrame, shape: str, name: str) -> DataFrame:
    """df (list, part, ...) with the tokens of part, which are those of its list only, and their signature; written once."""
    made = df.mapInArrow(_tokens, f"{shape}, tokens array<bigint>").withColumn("tokens", F.expr("transform(tokens, t -> xxhash64(list, t))"))
    return stored(made.withColumns(dict(zip(("low", "high"), map(F.expr, SIGNATURE)))), name)


def _prefixes(sets: DataFrame, key: list[str], table: Column, t: float, index: bool) -> DataFrame:
    """A row for each of the rarest tokens of a set, one of which any similar set shares, with its place. Frequent tokens are cut into slices, which the index has all."""
    size = F.size("tokens")
    held = by_rarity(sets.select(*key, "low", "high", "tokens"), table, (size - F.ceil(size * t - 1e-9) + 1).cast("int")).select(*key, "low", "high", size.alias("size"), "ordered")
    rows = held.select(*key, "low", "high", "size", F.posexplode_outer("ordered").alias("place", "o")).select(*key, "low", "high", "size", "place", "o.*").filter("token is not null")
    slices = F.greatest(F.ceil(F.col("share") / RARE), F.lit(1)).cast("int")
    cut = F.explode(F.sequence(F.lit(0), slices - 1)) if index else F.pmod(F.xxhash64(*key), slices).cast("int")
    return rows.withColumn("slice", cut).drop("share")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [x == y or edits(x, y, slips(len(y))) <= slips(len(y)) for x, y in zip(b.column("part").to_pylist(), b.column("text").to_pylist())]
        yield b.select(["list", "part", "canonical_id", "similarity"]).filter(pa.array(good, pa.bool_()))


def _best(df: DataFrame, *key: str) -> DataFrame:
    """The row of each key with the greatest similarity; ties go to the lesser id."""
    top = F.min(F.struct((-F.col("similarity")).alias("s"), "canonical_id")).alias("b")
    return df.groupBy(*key).agg(top).select(*key, F.col("b.canonical_id").alias("canonical_id"), (-F.col("b.s")).alias("similarity"))


def similar(parts: DataFrame, entries: DataFrame, t: float) -> DataFrame:
    """(list, part, canonical_id, similarity): of different squeezed texts (list, part) those that have an entry of entries (list, id, text) with a Jaccard similarity of t or more that passes the check, and the most similar one; ties go to the lesser id."""
    known = entries.filter("list is not null and id is not null and text is not null").select("list", F.col("id").cast("string").alias("id"), F.col("text").alias("val")).distinct()
    squeezed = known.select("list", "val").distinct().mapInArrow(_split({}), "list string, val string, parts array<string>")
    listed = known.join(squeezed, ["list", "val"]).select("list", "id", F.explode("parts").alias("part")).distinct()
    right = _sets(listed.select("list", "part", "id"), "list string, part string, id string", "entries")
    left = _sets(parts.select("list", "part"), "list string, part string", "parts")
    table = shares([left, right])
    a, b = _prefixes(left, ["list", "part"], table, t, False), _prefixes(right, ["list", "id"], table, t, True)
    on = ["list", "token", "slice"]
    met = a.withColumnsRenamed({c: f"a_{c}" for c in a.columns if c not in on}).join(b.withColumnsRenamed({c: f"b_{c}" for c in b.columns if c not in on}), on)
    n, m, i, j = (F.col(c) for c in ("a_size", "b_size", "a_place", "b_place"))
    need = F.ceil((n + m) * (t / (1 + t)) - 1e-9)  # tokens that both share
    good = (m >= t * n) & (n >= t * m) & (F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= need)
    good = good & (lacking(("a_low", "a_high"), ("b_low", "b_high")) <= n - need) & (lacking(("b_low", "b_high"), ("a_low", "a_high")) <= m - need)
    pairs = met.filter(good).select("list", F.col("a_part").alias("part"), F.col("b_id").alias("id")).distinct()
    pairs = wide(pairs, "list", "part")
    both = pairs.join(left.select("list", "part", "tokens"), ["list", "part"]).join(right.select("list", "id", F.col("part").alias("text"), F.col("tokens").alias("others")), ["list", "id"])
    shared = F.size(F.array_intersect("tokens", "others"))
    scored = both.select("list", "part", "text", F.col("id").alias("canonical_id"), (shared / (F.size("tokens") + F.size("others") - shared)).alias("similarity")).filter(F.col("similarity") >= t)
    return _best(scored.mapInArrow(_checked, "list string, part string, canonical_id string, similarity double"), "list", "part")


def _windows(segment: Column, longest: Column) -> Column:
    """All runs of up to `longest` words of a segment, without blanks, each once; the segment itself where longest is 0."""
    held = F.split(segment, " ")
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.least(longest, F.size(held) - i)), lambda n: F.array_join(F.slice(held, i + 1, n), ""))
    return F.when(longest > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(held) - 1), runs)))).otherwise(F.array(segment))


def _exact(sizes: DataFrame, entries: DataFrame, longest: dict[str, int]) -> DataFrame:
    """Values (list, val) that are a text of their list as it is, or in lists of phrases hold one, not as part of a longer word.

    A value is looked at only for the entries whose first word it has; a text without a word is looked for in every value.
    """
    keys, run = ["list", "val"], r"([\p{L}]+)"
    entries = entries.filter("list is not null and text is not null and text <> ''")
    same = sizes.join(entries.select("list", F.col("text").alias("val")), keys, "left_semi").select(*keys)
    if not longest:
        return same
    phrases = F.col("list").isin(*longest)
    named = entries.filter(phrases).select("list", "text", F.regexp_extract("text", run, 1).alias("word"))  # as it is read, so that its size is known to the join
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("val", F.lit(run), 1)))
    met = sizes.filter(phrases).select(*keys, F.explode_outer(words).alias("word")).join(named, ["list", "word"])
    at = F.expr("instr(val, text)")
    letter = lambda place: F.substring("val", place, F.lit(1)).rlike(r"\p{L}")
    # Most stand alone where they first occur; a pattern for each entry is costly, and is for the others.
    first = ((at == 1) | ~letter(at - 1)) & ~letter(at + F.length("text"))
    quoted = F.regexp_replace("text", r"([^\p{L}\p{N}\s])", r"\\$1")
    any_ = F.call_function("rlike", F.col("val"), F.concat(F.lit(r"(?<!\p{L})"), quoted, F.lit(r"(?!\p{L})")))
    return same.unionByName(met.filter(at > 0).filter(first | any_).select(*keys))


def map_values(values: DataFrame, entries: DataFrame, t: float, longest: dict[str, int] | None = None) -> DataFrame:
    """The free-entered ones of values (columns, list, val), with columns canonical_id and similarity: the most similar entry of entries (list, id, text) of the same list, or '' and 0.

    longest: lists whose entries may stand for any run of so many words of a value; in other lists a value stands for an entry as a whole. Values that are an entry as it is, or in these
    lists hold one, are not free-entered and are left out, and so are null values and lists. Blank values match nothing and stay; ties go to the lesser id; repeated entries count once; empty entries leave all
    unmatched. Other columns of values may have any names.
    """
    longest = longest or {}
    keys = ["list", "val"]
    sizes = stored(values.filter("list is not null and val is not null").groupBy(*keys).agg(F.count("*").alias("_n")), "values")
    free = stored(sizes.join(_exact(sizes, entries, longest), keys, "left_anti"), "free")
    split = stored(free.select(*keys).mapInArrow(_split(longest), "list string, val string, parts array<string>").select(*keys, F.explode("parts").alias("segment")), "segments")
    most = F.coalesce(*(F.when(F.col("list") == k, F.lit(n)) for k, n in longest.items()), F.lit(0))
    windows = split.select("list", "segment").distinct().select("list", "segment", F.explode(_windows(F.col("segment"), most)).alias("part"))
    best = stored(similar(wide(windows.select("list", "part").distinct()), entries, t), "similar")
    found = _best(split.join(_best(windows.join(best, ["list", "part"]), "list", "segment"), ["list", "segment"]), *keys)
    sized = free.join(found, keys, "left").withColumnsRenamed({"canonical_id": "_canonical_id", "similarity": "_similarity"})
    joined = hot_join(values.withColumn("_row", F.xxhash64(*values.columns)), sized, keys, "_n", "_row", sizes=free)
    return joined.select(*values.columns, F.coalesce("_canonical_id", F.lit("")).alias("canonical_id"), F.coalesce("_similarity", F.lit(0.0)).alias("similarity"))
