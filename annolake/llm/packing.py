"""Filling fixed-capacity containers with items (problem 8): minimum bin slack.

Each window holds the longest item left, and with it the multiset of the lengths left that comes closest to the capacity. Sums that can be
reached are the bits of one number, so that adding copies of a length is a shift. A filling is repeated as often as the counts last, so
the plan depends on the table of lengths and counts only, which is no longer than the capacity; items of a length are then numbered in parallel and
look their container up.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.operators.ranks import group_rank
from annolake.session import cut_lineage


@cache
def tokenizer(path: str, pattern: str):
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (id, text) to (id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64())], ["id", "tokens"])

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the lengths left, length -> number, whose sum comes closest to room without passing it.

    Lengths are taken in from the longest; the bits of `reached` are the sums so far. It ends as soon as room itself is reached. Going back over the
    steps tells which length each sum came from. The sums before a step are kept for the first step of each block only, and worked out again for the others of the
    block on the way back, so that memory is room x 2 x the root of the number of steps, in bits: 0.26 GB for a room of 2^20 and a million lengths.
    """
    mask = (1 << (room + 1)) - 1
    steps = []
    for length in sorted((n for n, c in counts.items() if 0 < n <= room and c > 0), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:  # copies in doubling steps
            step = min(step, left)
            steps.append((length, step))
            left -= step
            step *= 2
    block = max(1, isqrt(len(steps)))
    reached, kept, done = 1, [], 0
    for done, (length, step) in enumerate(steps):
        if done % block == 0:
            kept.append(reached)
        reached |= reached << (length * step) & mask
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    used: Counter = Counter()
    for k in range(len(kept) - 1, -1, -1):
        before, own = kept[k], steps[k * block : min((k + 1) * block, done + 1)]
        befores = []
        for length, step in own:
            befores.append(before)
            before |= before << (length * step) & mask
        for (length, step), earlier in zip(reversed(own), reversed(befores)):
            if not earlier >> total & 1:
                used[length] += step
                total -= length * step
    return dict(used)


def fillings(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, length -> number in one container), in the order of containers. Lengths are from 1 to the capacity."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        own = Counter(fill(left, capacity - longest))
        left[longest] += 1
        own[longest] += 1
        times = min(left[n] // k for n, k in own.items())
        out.append((times, dict(own)))
        for n, k in own.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


class Plan:
    """For each length: from which rank on its items stand in which filling."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.begins: dict[int, list[int]] = {}
        self.parts: dict[int, list[tuple[int, int]]] = {}
        seen: Counter = Counter()
        container = 0
        for times, own in fillings(histogram, capacity):
            for n, k in own.items():
                self.begins.setdefault(n, []).append(seen[n])
                self.parts.setdefault(n, []).append((container, k))
                seen[n] += times * k
            container += times
        self.containers = container

    def container(self, length: int, rank: int) -> int:
        """The container, from 1, of the item of this length with this rank, from 1."""
        i = bisect_right(self.begins[length], rank - 1) - 1
        first, k = self.parts[length][i]
        return first + (rank - 1 - self.begins[length][i]) // k + 1


def _placed(plans: dict[int, Plan]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in ("capacity", "tokens", "rank")))
            places = pa.array([plans[c].container(n, r) for c, n, r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("capacity", "id", "piece", "start", "tokens")), places], ["capacity", "id", "piece", "start", "tokens", "container"])

    return run


def pack(sizes: DataFrame, capacities: list[int], largest: int = 1 << 20) -> DataFrame:
    """Rows (capacity, id, piece, start, tokens, container): each item of sizes (id, tokens) in containers of each capacity.

    An item larger than a container is cut into pieces of the capacity and one of the rest; no other is cut. start is the place of the piece's first token. Items without a
    token, or of unknown size, have one piece of 0 tokens in container 0. Containers are numbered from 1, for each capacity; repeated ids are items of their own.
    Empty tables give no rows. largest: capacities beyond it are refused, as the table of lengths is held by the driver.
    """
    if bad := [c for c in capacities if not 0 < c <= largest]:
        raise ValueError(f"capacities must be from 1 to {largest}: {bad}")
    spark = sizes.sparkSession
    known = cut_lineage(sizes.select("id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")))
    each = known.withColumn("capacity", F.explode(F.array(*map(F.lit, sorted(set(capacities)))).cast("array<bigint>")))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0)))
    cut = each.select("id", "capacity", F.col("tokens").alias("whole"), F.explode(pieces).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    cut = cut.select("id", "capacity", (F.col("piece") + 1).alias("piece"), start.alias("start"), F.least(F.col("capacity"), F.col("whole") - start).alias("tokens"))
    histograms: dict[int, dict[int, int]] = {c: {} for c in capacities}
    for r in cut.filter("tokens > 0").groupBy("capacity", "tokens").agg(F.count("*").alias("n")).toLocalIterator():  # as many rows as the capacities add up to, at most
        histograms[r.capacity][r.tokens] = r.n
    plans = spark.sparkContext.broadcast({c: Plan(h, c) for c, h in histograms.items()})
    lengths = cut.filter("tokens > 0").withColumn("kind", F.col("capacity") * F.lit(largest * 2) + F.col("tokens"))
    ranked = group_rank(lengths, "kind", F.shiftrightunsigned(F.xxhash64("id", "piece"), 4), ["id", "piece"], "rank")
    shape = "capacity bigint, id bigint, piece bigint, start bigint, tokens bigint, container bigint"
    placed = ranked.select("capacity", "id", "piece", "start", "tokens", "rank").mapInArrow(lambda batches: _placed(plans.value)(batches), shape)
    empty = cut.filter("tokens = 0").select("capacity", "id", "piece", "start", "tokens", F.lit(0).cast("bigint").alias("container"))
    return placed.unionByName(empty)
