import random

from annolake.llm import leaks as k


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = (t or "").lower().split()
        for p in range(len(w) - n + 1):
            grams.setdefault(tuple(w[p : p + n]), set()).add(i)
    return sorted({(d, i) for d, t in docs for p in range(len((t or "").split()) - n + 1) for i in grams.get(tuple((t or "").lower().split()[p : p + n]), ())})


def test_against_brute_force(rows):
    random.seed(8)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(random.choices(words, k=random.choice([5, 12, 40])))) for i in range(30)]
    docs = []
    for d in range(300):
        own = random.choices(words, k=random.choice([0, 6, 60]))
        w = random.choice(items)[1].split()
        a = random.randrange(len(w))
        docs.append((d, " ".join(own[:5] + w[a : a + random.randint(6, 30)] + own[5:])))
    docs += [(1000, None), (1001, ""), (0, docs[0][1]), (1002, docs[5][1] + " " + docs[5][1])]
    got = sorted({(r.doc_id, r.item_id) for r in k.leaks(rows(docs, "id long, text string"), rows(items, "id long, text string")).collect()})
    assert got == brute(docs, items, 12) and got


def test_dress_and_edges(rows):
    item = "Ở phòng đo ẩm bậc 6, tổ quan sát bôi tẩy tế bào chết lên cẳng tay"
    docs = rows([(1, "x\n> " + item.upper().replace(" ", "\n"), 0), (2, "o phong do am bac 6 to quan sat boi", 0), (3, "o phong do am bac 6 to quan sat boi tay", 0), (3, "o phong do am bac 6 to quan sat boi tay", 0), (None, item, 0)], "id long, text string, words int")
    items = rows([(7, item), (8, None), (9, "ngắn quá"), (7, item), (10, "")], "id long, text string")
    assert sorted(map(tuple, k.leaks(docs, items, 10).collect())) == [(1, 7), (2, 7), (3, 7)]
    assert sorted(map(tuple, k.leaks(docs, items, 11).collect())) == [(1, 7), (3, 7)]
    assert k.leaks(docs.limit(0), items).collect() == [] and k.leaks(docs, items.limit(0)).collect() == []


def test_proximity(rows):
    item = " ".join(f"t{i}" for i in range(30))
    doc = " ".join([f"t{i}" for i in range(3, 9)] + ["zz", "yy"] + [f"t{i}" for i in range(10, 17)])
    docs, items = rows([(1, doc)], "id long, text string"), rows([(5, item)], "id long, text string")
    assert k.leaks(docs, items).collect() == []
    assert [(r.longest, r.near) for r in k.near_leaks(docs, items, 12, 5, 3).collect()] == [(7, 13)]
    assert k.near_leaks(docs, items, 14, 5, 3).collect() == []


def brute_chain(pieces, slack):
    best = []
    for i, (a, d, n) in enumerate(pieces := sorted(pieces)):
        best.append(n + max((best[k] for k in range(i) if 0 <= a - pieces[k][0] - pieces[k][2] <= slack and 0 <= d - pieces[k][1] - pieces[k][2] <= slack), default=0))
    return max(best, default=0)


def test_chains():
    random.seed(4)
    assert k.chained([(0, 0, 5), (5, 9, 4), (30, 40, 6)], 3) == 6 and k.chained([], 3) == 0
    for _ in range(300):
        pieces = list({(random.randrange(20), random.randrange(20), random.randint(1, 6)) for _ in range(random.randrange(12))})
        assert k.chained(pieces, 3) == brute_chain(pieces, 3)


def test_long_document(rows):
    item = " ".join(f"t{i}" for i in range(20))
    doc = "a b c " * 30_000 + item
    assert [r.item_id for r in k.leaks(rows([(1, doc)], "id long, text string"), rows([(5, item)], "id long, text string")).collect()] == [5]
