import random

import pytest

from annolake.llm import overlap as o

WORDS = [f"w{i}" for i in range(60)]


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(before[j] + 1 if x == y else 0, before[j + 1], row[j]))
    return row[-1]


def changed(text, edits):
    text = list(text)
    for _ in range(edits):
        i = random.randrange(len(text))
        kind = random.randrange(4)
        if kind == 0:
            text.insert(i, random.choice(WORDS))
        elif kind == 1 and len(text) > 1:
            del text[i]
        elif kind == 2:
            text[i] = random.choice(WORDS)
        else:
            w = text.pop(i)
            text.insert(random.randrange(len(text) + 1), w)
    return text


def test_common():
    random.seed(3)
    for _ in range(200):
        a, b = random.choices(WORDS[:6], k=random.randrange(12)), random.choices(WORDS[:6], k=random.randrange(12))
        assert o.common(a, b) == brute_common(a, b)


@pytest.mark.parametrize("share, rare", [(0.0, 0.01), (0.5, 0.01), (0.5, 0.5), (0.9, 0.1)])
def test_no_pair_is_lost(rows, monkeypatch, share, rare):
    monkeypatch.setattr(o, "RARE", rare)
    random.seed(5)
    left = [(i, " ".join(random.choices(WORDS, k=random.choice([1, 3, 8, 20, 50])))) for i in range(150)] + [(900, "w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    right = [(1000 + i, " ".join(changed(random.choice(left)[1].split(), random.randrange(9)))) for i in range(400)] + [(2000, "w1 w1 w1 w1 w1 w1 w1 w2 w3")]
    got = sorted(map(tuple, o.near_same(rows(left, "id long, text string"), rows(right, "id long, text string"), 6, share).collect()))
    want = sorted((i, j) for i, a in left for j, b in right if o.same(a.split(), b.split(), 6, share))
    assert got == want and len(want) > 100
    planted = [(" ".join(t.split()), changed(t.split(), 6)) for _, t in left if len(t.split()) >= 20]
    assert all(o.same(a.split(), b, 6) for a, b in planted)


def test_allowed():
    assert [o.allowed(n, 6, 0.5) for n in (1, 2, 3, 7, 8, 13, 50)] == [0, 0, 1, 3, 3, 6, 6]
    assert [o.allowed(n, 6, 0.0) for n in (1, 2, 7, 8)] == [0, 1, 6, 6]


def test_dress_and_edges(rows):
    left = rows([(1, "Xin hỏi, giá bao nhiêu ạ?", "q"), (1, "Xin hỏi, giá bao nhiêu ạ?", "q"), (2, None, ""), (3, " !", ""), (None, "xin hoi", "")], "id long, text string, key string")
    right = rows([(7, "XIN HOI gia  bao nhieu a"), (8, None), (9, "khác hẳn"), (7, "xin hỏi giá bao nhiêu ạ")], "id long, text string")
    got = sorted(map(tuple, o.near_same(left, right, 6).collect()))
    assert got == [(1, 7)] * 4
    assert o.near_same(left.limit(0), right, 6).collect() == [] and o.near_same(left, right.limit(0), 6).collect() == []


def test_long_text(rows):
    text = " ".join(random.choices(WORDS, k=20_000))
    got = o.near_same(rows([(1, text)], "id long, text string"), rows([(2, text + " x y")], "id long, text string"), 6).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_hot_texts(rows, monkeypatch):
    from annolake.operators import skew

    monkeypatch.setattr(skew, "HOT_LEAST", 5)
    left = rows([(i, f"a{i} b{i} c{i} d{i}") for i in range(7)] + [(100 + i, "một câu hay gặp") for i in range(40)], "id long, text string")
    assert o.near_same(left, left, 6, 0.5).count() == 7 + 40 * 40


def broadcasts(node):
    """Columns of each broadcast of a plan as it starts, without its subqueries."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return broadcasts(node.initialPlan())
    below = [x for i in range(node.children().size()) for x in broadcasts(node.children().apply(i))]
    return below + [[node.output().apply(i).name() for i in range(node.output().size())]] * (node.nodeName() == "BroadcastExchange")


@pytest.mark.parametrize("name", ["p2_found", "p2_classes", "p2_report"])
def test_only_hot_keys_are_broadcast(spark, name):
    from conftest import SMALL

    from annolake.llm.queries import QUERIES

    sent = broadcasts(QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan())
    assert bool(sent) == (name != "p2_classes") and all("_hot" in columns for columns in sent)
