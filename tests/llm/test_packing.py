import random
from collections import Counter
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from annolake.llm import packing as p


def test_fill_is_the_closest():
    random.seed(9)
    for _ in range(200):
        counts = {random.randint(1, 15): random.randint(1, 4) for _ in range(4)}
        room = random.randint(0, 30)
        used = p.fill(counts, room)
        total = sum(n * k for n, k in used.items())
        items = [n for n, k in counts.items() for _ in range(k)]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        assert total == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in used.items())


def test_plan_uses_all():
    random.seed(10)
    histogram = Counter(random.choices(range(1, 101), k=5000))
    done: Counter = Counter()
    for times, own in p.fillings(histogram, 100):
        assert sum(n * k for n, k in own.items()) <= 100
        for n, k in own.items():
            done[n] += times * k
    assert done == histogram


def test_round_trip(rows):
    random.seed(11)
    sizes = [(i, random.choice([0, 3, 50, 64, 65, 130, 700])) for i in range(2000)] + [(5000, None), (7, 20)]
    table = rows(sizes, "id long, tokens long").withColumn("capacity", F.lit("other"))
    got = p.pack(table, [64, 256, 64]).collect()
    for capacity in (64, 256):
        mine = [r for r in got if r.capacity == capacity]
        whole = Counter()
        for r in mine:
            whole[r.id] += r.tokens
        want = Counter()
        for i, n in sizes:
            want[i] += n or 0
        assert whole == want
        room = Counter()
        for r in mine:
            room[r.container] += r.tokens
        del room[0]
        assert max(room.values()) <= capacity and sorted(room) == list(range(1, len(room) + 1))
        assert len(room) - 1 <= sum(room.values()) / capacity * 1.05 + 1
        assert all(r.piece == 1 for r in mine if (n := dict(sizes)[r.id] or 0) <= capacity and r.id != 7)
        assert all(r.start == (r.piece - 1) * capacity for r in mine)
    assert p.pack(table.limit(0), [64]).collect() == []
    with pytest.raises(ValueError):
        p.pack(table, [0])


def test_tokenizer(rows):
    tokenizers = pytest.importorskip("public_tokenizers")
    count = p.counter(str(tokenizers.path("byte_bpe_multi_50k.tiktoken")), tokenizers.PATTERN)
    table = rows([(1, "Xin chào"), (2, ""), (3, None), (4, "a b " * 40_000)], "id long, text string")
    got = {r.id: r.tokens for r in table.mapInArrow(count, "id long, tokens long").collect()}
    assert got[1] > 0 and got[2] == got[3] == 0 and got[4] >= 40_000
