import random

import pytest

from annolake.llm import mapping as m


@pytest.mark.parametrize("rare", [0.01, 0.5])
def test_prefix_filter_finds_the_best(rows, monkeypatch, rare):
    monkeypatch.setattr(m, "RARE", rare)
    random.seed(6)
    letters = "abcdeghiklmn"
    names = [(f"n{i:03}", "".join(random.choices(letters, k=random.randint(3, 14)))) for i in range(150)]
    parts = set()
    for _ in range(600):
        typed = list(random.choice(names)[1])
        for _ in range(random.randint(0, 4)):
            typed[random.randrange(len(typed))] = random.choice(letters)
        parts.add("".join(typed))
    want = {}
    for p in parts:
        scored = []
        for i, text in names:
            a, b = set(m.tokens(p)), set(m.tokens(text))
            j = len(a & b) / len(a | b)
            if j >= 0.45 and (p == text or m.edits(p, text, m.slips(len(text))) <= m.slips(len(text))):
                scored.append((-j, i))
        if scored:
            want[p] = min(scored)[1]
    got = m.similar(rows([("x", p) for p in parts], "list string, part string"), rows([("x", *n) for n in names], "list string, id string, text string"), 0.45)
    assert {r.part: r.canonical_id for r in got.collect()} == want and len(want) > 200


def test_short_entries(rows):
    entries = rows([("x", "1", "abc"), ("x", "2", "abcdefg"), ("y", "3", "ab")], "list string, id string, text string")
    typed = rows([("x", v) for v in ("ab", "abd", "xbc", "ABC", "abcdeff", "abdcefg", "axcxexg")], "list string, val string")
    got = {r.val: r.canonical_id for r in m.map_values(typed, entries, 0.45).collect()}
    assert got == {"ab": "", "abd": "", "xbc": "", "ABC": "1", "abcdeff": "2", "abdcefg": "2", "axcxexg": ""}


@pytest.mark.parametrize("a, b, n", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "bc", 1), ("abcd", "badc", 2), ("abc", "xyz", 3), ("", "ab", 2)])
def test_edits(a, b, n):
    assert m.edits(a, b, 5) == n and m.edits(a, b, 1) == min(n, 2)


def test_labels(rows):
    entries = rows([("l", "l1:truoc_mua_hang", "truoc_mua_hang"), ("l", "l1:sau_mua_hang", "sau_mua_hang"), ("l", None, "x"), ("l", "y", None), ("l", "l1:sau_mua_hang", "sau_mua_hang"), ("k", "k:khac", "khác")], "list string, id string, text string")
    typed = ["TRƯỚC MUA HÀNG", '["sau_mua_hang"]', "trulc_mua_hng", "SauMuaHang", "khác", "", "-", "s" * 40_000, "sau_mua_hang", None]
    table = rows([(i, "l", v, 7) for i, v in enumerate(typed)] + [(3, "l", "SauMuaHang", 7), (99, None, "x", 7)], "row_id int, list string, val string, text int")
    got = sorted((r.row_id, r.canonical_id) for r in m.map_values(table, entries, 0.45).collect())
    assert got == sorted([*enumerate(["l1:truoc_mua_hang", "l1:sau_mua_hang", "l1:truoc_mua_hang", "l1:sau_mua_hang", "", "", "", ""]), (3, "l1:sau_mua_hang")])
    assert {r.canonical_id for r in m.map_values(rows([(1, "l", "a")], "row_id int, list string, val string"), entries.limit(0), 0.45).collect()} == {""}
    assert m.map_values(rows([], "row_id int, list string, val string"), entries, 0.45).collect() == []


def test_brands_in_names(rows, monkeypatch):
    from annolake.operators import skew

    brands = rows([("b", "B1", "Cocolymph"), ("b", "B2", "Bạch Trà Viên"), ("b", "B3", "Sữa Gạo Làng"), ("b", "B4", "Zyt+")], "list string, id string, text string")
    typed = ["-15 %180.000 ₫Coco lymph Kem 5ml", "Kem bạch trà viêên 50g", "SữaGạoLàng Dầu xả", "Mufflit Zyt", "ＣＯＣＯＬＹＭＰＨ x", "Co\u200bcolуmph y", "a Zyt+s", "xZyt+ Zyt+ Cocolympha"]
    exact = ["x Cocolymph", "a Zyt+ b", "xZyt+ Zyt+ y", "180.000 ₫Bạch Trà Viên, 5ml"]
    table = rows([(i, "b", v) for i, v in enumerate(typed + exact)] + [(0, "b", typed[0])] * 30, "row_id int, list string, val string")
    run = lambda: sorted((r.row_id, r.canonical_id) for r in m.map_values(table, brands, 0.45, {"b": 4}).collect())
    want = sorted([*enumerate(["B1", "B2", "B3", "B4", "B1", "B1", "B4"])] + [(0, "B1")] * 30)
    assert run() == want
    monkeypatch.setattr(skew, "HOT_LEAST", 5)
    assert run() == want
