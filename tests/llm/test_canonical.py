import unicodedata

import pytest
from pyspark.sql import functions as F

from annolake.llm import canonical as c


@pytest.mark.parametrize("text, form", [
    ("Ｘｉｎ ｈỏｉ ạ！", "Xin hỏi ạ!"), (unicodedata.normalize("NFD", "tiền"), "tiền"), ("tiền", "tiền"), ("a b c　d", "a b c d"), ("k​huya­ ﻿i͏n", "khuya in"),
    ("Ðang Ɖã", "Đang Đã"), ("Reрaіr Вalm", "Repair Balm"), ("trοng", "trong"), ("Kеm", "Kem"), ("𝐊em ﬁne", "Kem fine"),
])
def test_cases(text, form):
    assert c.canonical(text) == form and c.canonical(form) == form


@pytest.mark.parametrize("text", ["Đặt hàng, “nhé”\t…\n«a»", "крем для лица", "(α-arbutin) β-glucan", "❤️ 👨‍👩‍👧 👩‍🔬 1️⃣ 🇻🇳", "(nhãn ghi 세럼) 美容液", "", "180.000 ₫ – 50%"])
def test_ordinary(text):
    assert c.canonical(text) == text


def test_joiner_outside_emoji():
    assert c.canonical("phả‍i họp ‍👩") == "phải họp 👩"


def test_table_has_no_conflicts():
    made = c.table()
    assert all(c.canonical(f) == f for f in made.values())
    assert all(c.canonical(x + "a") == (c.canonical(x) + "a") for x in list(made)[:300])


def test_fields(rows):
    table = rows([(1, "a​b", "plain", 9), (2, None, "", 9), (2, "ｄa", "ｄa", 9), (3, "x" * 50_000 + " ", "c", 9)], "id long, f string, g string, form int")
    got = sorted((r.id, r.field_name, r.form[:5]) for r in c.canonical_fields(table, "id", ["f", "g"]).collect())
    assert got == [(1, "f", "ab"), (2, "f", "da"), (2, "g", "da"), (3, "f", "xxxxx")]
    assert c.canonical_fields(table.limit(0), "id", ["f"]).collect() == []


def test_prefilter_keeps_all(rows):
    import random

    random.seed(2)
    pool = "aạđĐ ₫“”…é1.\t" + "".join(random.sample(sorted(c.table()), 200)) + "".join(c.LOOKS) + "̣́세á"
    texts = ["".join(random.choices(pool, k=4)) for _ in range(3000)] + [x for x in pool]
    got = rows(list(enumerate(texts)), "i int, t string").select("i", c.suspect(F.col("t")).alias("s")).collect()
    assert all(r.s for r in got if c.canonical(texts[r.i]) != texts[r.i])


@pytest.mark.parametrize("text, form", [
    ("K Å Ω ι", "K Å Ω ι"), ("ꓢerum ᎪBC", "Serum ABC"), ("tıền ðang ɡood", "tiền đang good"), ("ÐHQG ÐẶT LácÐác", "ĐHQG ĐẶT LácĐác"), ("е̣̂m", "ệm"), ("ｅ̣̂", "ệ"), ("e​́m", "ém"),
])
def test_rules_bound_to_words(text, form):
    assert c.canonical(text) == form and c.canonical(form) == form


@pytest.mark.parametrize("text", ["հասարակ", "Isık ılık", "Það ð VIÐ", "ᏣᎳᎩ", "ꓡꓲ-ꓢꓴ", "/ɡʊd/"])
def test_words_of_other_scripts(text):
    assert c.canonical(text) == text


def test_conflicts_are_errors():
    rules = c.Rules()
    rules.add("a", "b")
    with pytest.raises(ValueError):
        rules.add("a", "c")
    rules.add("b", "c")
    with pytest.raises(ValueError):
        rules.checked()


def test_longest_match():
    assert c.Trie({"a": "1", "abc": "2", "b": "3"}).run("abcabdx") == "213dx"
