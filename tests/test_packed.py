import json
import random

import pytest
from pyspark.sql import functions as F

from annolake.operators.packed import explode_packed, split_packed

CASES = [
    ('["retinol", "lọ vỡ"]', True, ["retinol", "lọ vỡ"]),
    ("['freeship', 'loại \"mini\"', 'gọi lại']", True, ["freeship", 'loại "mini"', "gọi lại"]),
    ('"Lấy ""bản mini"" được không?", "Em, b"', False, ['Lấy "bản mini" được không?', "Em, b"]),
    ('["A, b?", "Lấy \\"bản mini\\"?"]', False, ["A, b?", 'Lấy "bản mini"?']),
    ('trôi nền | "dầu / mụn" | test thử', True, ["trôi nền", "dầu / mụn", "test thử"]),
    ("1. vị dâu; 2. hàng giả", True, ["vị dâu", "hàng giả"]),
    ("(1) A, b? (2) C d? (3) E", False, ["A, b?", "C d?", "E"]),
    ("“gọi lại”, “giá; bao”", True, ["gọi lại", "giá; bao"]),
    ("24/7, SPF50+", True, ["24/7", "SPF50+"]),
    ("retinol / chậm giao / 24/7", True, ["retinol", "chậm giao", "24/7"]),
    ("- bầu dùng\n- da nhạy\r\n• x", True, ["bầu dùng", "da nhạy", "x"]),
    ("; a;;；b || c、d\te", True, ["a", "b", "c", "d", "e"]),
    ('loại "mini", combo', True, ['loại "mini"', "combo"]),
    ("a, a, a", True, ["a", "a", "a"]),
    ("a\ue010b\ue011, \ue012a; \ue012\ue010c", True, ["a\ue010b\ue011", "\ue012a", "\ue012\ue010c"]),
    ("Một, hai; ba", False, ["Một, hai", "ba"]),
    ('"x', True, ['"x']),
    ("", True, []),
    ("  \n", True, []),
    (None, True, []),
    ("[]", True, []),
    ("[a, b]", True, ["a", "b"]),
    ('"a, b" "c"', True, ["a, b", "c"]),
    ("“a”“b”", True, ["a", "b"]),
    ('["\\u0111\\u1ed5i \\"x\\"", "c"]', True, ['đổi "x"', "c"]),
    ('["broken \\" ]', True, ['"broken "']),
]


@pytest.mark.parametrize("comma", [True, False])
def test_cases(rows, comma):
    cases = [(i, t, want) for i, (t, c, want) in enumerate(CASES) if c == comma]
    got = rows([c[:2] for c in cases], "i int, t string").select("i", split_packed(F.col("t"), comma).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: want for i, _, want in cases}


def test_round_trip(rows):
    random.seed(4)
    values = ["lọ vỡ", "24/7", "kem, sữa", "giá; ưu đãi", "đổi | trả", 'loại "mini"', "SPF50+", "100ml"]
    made = [[random.choice(values) for _ in range(random.randint(1, 9))] for _ in range(60)]
    forms = [lambda v: json.dumps(v, ensure_ascii=False), lambda v: ", ".join('"' + x.replace('"', '""') + '"' for x in v), lambda v: repr(v), lambda v: ";".join('"' + x.replace('"', '""') + '"' for x in v)]
    table = rows([(i, forms[i % 4](v)) for i, v in enumerate(made)], "id long, t string")
    got = {}
    for r in explode_packed(table, "id", {"t": True}).collect():
        got.setdefault(r.id, {})[r.pos] = r.val
    assert [[got[i][p] for p in range(1, len(v) + 1)] for i, v in enumerate(made)] == made


def test_whole_rows(rows):
    table = rows([(1, "a,b", "x", 5), (1, "a,b", None, 5), (None, "c", "", 6)], "id long, f string, g string, pos int")
    got = sorted((r.id or 0, r.field_name, r.pos, r.val) for r in explode_packed(table, "id", {"f": True, "g": False}).collect())
    assert got == [(0, "f", 1, "c"), (1, "f", 1, "a"), (1, "f", 1, "a"), (1, "f", 2, "b"), (1, "f", 2, "b"), (1, "g", 1, "x")]
    assert explode_packed(table.limit(0), "id", {"f": True}).collect() == []
    long = rows([(1, ",".join(["v"] * 20_000))], "id long, f string")
    assert explode_packed(long, "id", {"f": True}).count() == 20_000
