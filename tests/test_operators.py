import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions import labels, rules, text, vectors
from annolake.operators import annotate, audit, curate, metrics, retrieval, splits, taxonomy
from annolake.operators.ranks import group_rank
from annolake.operators.skew import hot_join, sliced_join, spread_join
from annolake.sources import files
from annolake.streaming.ingest import file_stream, latest_version, upsert_stream


def values(rows, column, cases, schema="t string"):
    table = rows([(i, c) for i, c in enumerate(cases)], f"i int, {schema}")
    return [r.v for r in table.select("i", column.alias("v")).orderBy("i").collect()]


def test_vague(rows):
    cases = ["", None, " \t", "Gì?", "Sao", "có thế này", "Có không gì?", "Có không?", "Bao nhiều tiền ạ?", "Sp tốt không"]
    want = ["empty_sentence"] * 3 + ["too_short_chars_3", "too_short_chars_3", "too_few_meaningful_words_0", "question_word_only", "", "", ""]
    assert values(rows, rules.vague(F.col("t")), cases) == want


def test_asks(rows):
    assert values(rows, rules.asks(F.col("t")), ["mua gì?", "mua gì vậy", "đây là gì", "Bao Giờ có", None, "không"]) == [False, True, True, True, False, False]


def test_text(rows):
    assert values(rows, text.fold(F.col("t")), ["ĐẶT Hàng", "tiền", "tiền", None]) == ["dat hang", "tien", "tien", None]
    assert values(rows, text.words(F.col("t")), ["Giá tiền, 5ml!"]) == [["gia", "tien", "5ml"]]
    assert values(rows, text.blank(F.col("t")), [None, "  ", "a"]) == [True, True, False]
    assert values(rows, text.word_count(F.col("t")), [None, " a  b c "]) == [0, 3]


def test_rules(rows):
    assert values(rows, rules.confidence(F.col("t")), ["", "0.7", ".69", "Thap", None]) == ["Cao", "Cao", "Trung binh", "Thap", "Cao"]
    assert values(rows, rules.product_name(F.col("t")), ["-15 %180.000 ₫935.000 ₫Kem lót 50g\nSunny3.3(326)15", "Tặng: Túi vải 66.000 ₫Dầu gội 15mlNew Look3.0(11)53", None]) == ["Kem lót 50g", "Dầu gội 15ml", None]
    assert values(rows, rules.link_id(F.col("t")), ["https://a.b/san-pham/kem-12.html?x=1", "https://a.b/c/44.html", None]) == ["kem-12", "44", None]
    assert values(rows, rules.json_in(F.col("t"), "a int")["a"], ['```json\n{"a": 3}\n```', "no", None]) == [3, None, None]
    assert values(rows, rules.is_slug(F.col("t")), ["ab_1", "a", "Ab", "ab\n", None]) == [True, False, False, False, False]
    assert values(rows, rules.links(F.col("t")), ['<a href="x">1</a> <A class=c HREF=\'y\'>2</A> <a href="x">']) == [["x", "y"]]
    assert values(rows, rules.titled(F.col("t")), ["mua_ngay"]) == ["Mua Ngay"]


def test_labels(rows):
    assert values(rows, labels.first_of(F.col("t")), ['["a", "b"]', "c", None, "[]"]) == ["a", "c", "", ""]
    assert values(rows, F.array(*labels.levels_of(F.col("t"))), ["a::b::c::d", "a", ""]) == [["a", "b", "c::d"], ["a", "", ""], ["", "", ""]]
    assert values(rows, labels.normal_label(F.col("t")), [" Mua  Hàng ", None]) == ["mua hàng", None]
    table = rows([("", "m"), (None, "m"), ("g", "m")], "g string, m string")
    assert [r[0] for r in table.select(labels.gold_or_machine([F.col("g")], [F.col("m")])[0]).collect()] == ["m", "m", "g"]


@pytest.mark.parametrize("n, sizes", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 0, 1)), (4, (3, 0, 1)), (5, (4, 0, 1)), (10, (7, 2, 1)), (20, (14, 3, 3))])
def test_split_sizes(rows, n, sizes):
    r = splits.split_sizes(rows([("s", n)], "stratum string, n long"), 0.7, 0.15).collect()[0]
    assert (r.n_train, r.n_val, r.n_test) == sizes


def test_split_is_whole_and_stable(rows):
    table = rows([(i, "a", f"b{i % 3}", f"c{i % 7}" if i % 5 else None) for i in range(700)], "id long, l1 string, l2 string, l3 string")
    one = {r.id: r.split for r in splits.split(table, "id", 0.7, 0.15, 3, 1).collect()}
    two = {r.id: r.split for r in splits.split(table.repartition(9), "id", 0.7, 0.15, 3, 1).collect()}
    assert one == two and len(one) == 700 and set(one.values()) == {"train", "val", "test"}
    with pytest.raises(ValueError):
        splits.split_sizes(rows([("s", 1)], "stratum string, n long"), 0.9, 0.2)


def test_coverage(rows):
    table = rows([(i, f"b{i % 9}", f"c{i % 40}") for i in range(500)], "id long, l2 string, l3 string")
    got = splits.coverage_sample(table, "id", 100, 3).collect()
    assert len(got) == len({r.id for r in got}) == 100
    assert len({r.l2 for r in got}) == 9 and len({r.l3 for r in got}) == 40
    assert len(splits.coverage_sample(table, "id", 5, 3).collect()) == 5


def test_ranks_of_a_hot_group(rows):
    table = rows([(i, "hot" if i % 3 else f"g{i}") for i in range(900)], "id long, g string")
    got = group_rank(table, "g", F.shiftrightunsigned(F.xxhash64("id"), 4), ["id"], "r").collect()
    hot = sorted(r.r for r in got if r.g == "hot")
    assert hot == list(range(1, len(hot) + 1)) and all(r.r == 1 for r in got if r.g != "hot")


def test_joins_of_hot_keys(rows):
    left = rows([(i, "hot" if i % 3 else f"k{i}") for i in range(30_000)], "id long, k string")
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    assert hot_join(left, groups, ["k"], "n", "id").count() == 30_000
    assert hot_join(left, groups.filter("n < 9"), ["k"], "n", "id", "left", groups).count() == 30_000
    few = rows([("hot", 1), ("hot", 2), ("k3", 3)], "k string, v int")
    one = few.dropDuplicates(["k"])
    assert sliced_join(left, one, ["k"], "id").count() == left.join(one, "k").count() and sliced_join(left, one, ["k"], "id", "left_anti").count() == left.join(one, "k", "left_anti").count()
    assert spread_join(few, left, ["k"], "id").count() == few.join(left, "k").count()


def test_audit(rows):
    table = rows([("a", "b", "x")] * 3 + [("z", "b", "x")] * 3 + [("a", "c", "y"), (None, None, ""), (None, None, None)], "l1 string, l2 string, l3 string")
    got = {r.l3: r for r in audit.label_distribution(table, rows([("x",), ("x",)], "l3 string"), 5, 5).collect()}
    assert (got["x"].l1, got["x"]["count"], got["x"].gap, got["x"].excess, got["x"].in_taxonomy, got["x"].status) == ("a", 6, 0, 1, True, "sufficient")
    assert (got["y"].in_taxonomy, got["y"].gap, got["y"].status) == (False, 4, "needs_augmentation")
    assert audit.label_distribution(table.limit(0), rows([], "l3 string")).count() == 0
    dup = {r.kind: r for r in audit.duplicates(rows([("A ",), ("a",), ("a",), (None,), (None,)], "t string"), {"exact": F.col("t"), "loose": F.lower(F.trim("t"))}).collect()}
    assert (dup["exact"].members, dup["exact"].surplus, dup["loose"].members) == (4, 2, 5)


def test_metrics_against_loops(rows):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "d"), ("b", "a"), ("a", "a")]
    r = metrics.hierarchical(rows(pairs, "t string, p string"), {"l": ("t", "p")}).collect()[0]
    names = {x for p in pairs for x in p}
    f1 = {n: 2 * sum(t == p == n for t, p in pairs) / sum((t == n) + (p == n) for t, p in pairs) for n in names}
    assert r.accuracy == 0.5 and r.macro_f1 == round(sum(f1.values()) / 4, 6) and r.weighted_f1 == round(sum(f1[t] for t, _ in pairs) / 6, 6)
    assert sum(x.n for x in metrics.confusion(rows(pairs, "t string, p string"), "t", "p", 2).collect()) == 6


def test_curate(rows):
    table = rows([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, o int")
    assert sorted((r.k or "", r.o) for r in curate.one_per_key(table, ["k"], F.col("o")).collect()) == [("", 4), ("a", 1), ("b", 3)]
    assert sorted((r.k or "", r.n) for r in curate.numbered(table, "k", "o", "n").collect()) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("b", 0)]
    assert sorted(r.k or "" for r in curate.without(table, rows([("a",), (None,)], "k string"), "k").collect()) == ["", "", "b"]
    assert [r.k for r in curate.overlap(table, rows([("b",), ("b",), (None,)], "k string"), "k").collect()] == ["b"]


def test_taxonomy(rows):
    table = rows([("AUTO-1", 1, "n1", "a", "b", "c", "t1"), ("INT-140", 2, "n2", "a", "b", "c", " t1 "), ("X", 3, "n3", "a", "b", "d", None), ("INT-133", 4, "n4", "e", "f", "g", "u"), ("Y", 5, "n5", "", "b", "d", "u")], "id string, ord long, name string, l1 string, l2 string, l3 string, txt string")
    got = {(r.l1, r.l3): r for r in taxonomy.merge_triples(table, ["txt"]).collect()}
    assert (got["a", "c"].new_id, got["a", "c"].members, got["a", "c"].txt) == ("INT-140", 2, "t1")
    assert got["a", "d"].new_id == "INT-134" and got["e", "g"].new_id == "INT-133" and len(got) == 3
    heads = taxonomy.siblings(rows([(i, "p", f"s{i}") for i in range(9)] + [(9, "q", "x")], "id int, l2 string, l3 string"), 3).collect()
    assert {r.id: r.siblings for r in heads}[0] == ["s1", "s2", "s3"] and {r.id: r.siblings for r in heads}[9] == []
    nodes, edges = taxonomy.graph(rows([("d", "a", "b", "c", "i1"), ("d", "a", "b", "c", "i2")], "domain string, l1 string, l2 string, l3 string, id string"))
    assert nodes.count() == 7 and edges.count() == 6


def test_vectors(rows):
    table = rows([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id long, vector array<float>")
    got = retrieval.top_similar(table.filter("id in (1, 4, 5)"), table, 2).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1), (1, 3, 2)]
    assert retrieval.top_similar(table.limit(0), table, 2).count() == 0


def test_files(spark, rows, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("level_3", T.StringType())])
    (tmp_path / "a.json").write_text('{"stats": {}, "results": [{"id": "1", "level_3": "x"}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text(' [{"id": "3", "level_3": "y"}]')
    (tmp_path / "c.json").write_text('{"rows": []}')
    assert [(r.id, r._ord) for r in files.read_results(spark, str(tmp_path / "a.json"), schema).collect()] == [("1", 0), ("2", 1)]
    assert [r.id for r in files.read_results(spark, str(tmp_path / "b.json"), schema).collect()] == ["3"]
    with pytest.raises(Exception, match="neither a list"):
        files.read_results(spark, str(tmp_path / "c.json"), schema).collect()
    table = rows([("1", 'a,"b"\nc', 0), ("2", None, 1)], "id string, t string, o long")
    files.write_csv(table, str(tmp_path / "csv"), ["id", "t"])
    back = files.read_csv(spark, str(tmp_path / "csv"), ["id", "t", "gone"]).orderBy("id").collect()
    assert [(r.id, r.t, r.gone) for r in back] == [("1", 'a,"b"\nc', None), ("2", None, None)]
    files.write_results(table, str(tmp_path / "out"), {"seed": "1"}, "o", 1)
    assert sorted((r.seed, r.num_samples, r.results[0].id) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("1", 1, "1"), ("1", 1, "2")]
    assert sorted(r.id for r in files.read_results(spark, str(tmp_path / "out" / "*"), schema).collect()) == ["1", "2"]
    for n in (1, 2, 3):
        files.write_over(table.limit(n % 3), str(tmp_path / "over"))
    assert [spark.read.parquet(str(tmp_path / p)).count() for p in ("over.1", "over.2", "over")] == [1, 2, 0]
    with pytest.raises(Exception, match="nowhere"):
        files.done_ids(spark, "nowhere://x/y", "id")
    files.write_chunks(table, str(tmp_path / "chunks"), "o", 1)
    assert sorted(p for p in os.listdir(tmp_path / "chunks") if p.startswith("chunk")) == ["chunk=0", "chunk=1"]
    assert files.resume(table, str(tmp_path / "nothing"), "id").count() == 2
    assert files.resume(table, str(tmp_path / "chunks" / "chunk=0"), "id").count() == 1


def test_stream(spark, rows, tmp_path):
    one = rows([(1, 1, "a"), (2, 2, "b")], "k long, o long, v string")
    one.coalesce(1).write.parquet(str(tmp_path / "in" / "x1"))
    where = (str(tmp_path / "out"), str(tmp_path / "cp"))
    run = lambda: upsert_stream(file_stream(spark, str(tmp_path / "in" / "*"), one.schema), *where, "k", "o").awaitTermination()
    run()
    rows([(1, 5, "new"), (3, 6, "c"), (2, 1, "late")], "k long, o long, v string").coalesce(1).write.parquet(str(tmp_path / "in" / "x2"))
    run()
    run()
    assert sorted(map(tuple, latest_version(spark, where[0]).select("k", "o", "v").collect())) == [(1, 5, "new"), (2, 2, "b"), (3, 6, "c")]


def test_pages(rows):
    html = '<div class="qa item"><b>Giá&nbsp;sao?</b><script>x</script></div><div class="other">no</div><DIV CLASS=\'item\'> a &amp; b </DIV><div class="item"></div><div class="qa item">Giá sao?</div>'
    assert values(rows, rules.blocks(F.col("t"), "div", "item"), [html, None]) == [["Giá sao?", "a & b", "Giá sao?"], None]
    assert values(rows, rules.asked_questions(F.col("t"), "div", "item", 6), [html]) == [["Giá sao?"]]
    assert values(rows, rules.page_text(F.col("t")), ["<p>a<!-- x --> b</p>\n<style>q</style>"]) == ["a b"]


def test_vector_columns(rows):
    table = rows([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = table.select(vectors.norm(F.col("a")), vectors.unit(F.col("a")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [5.0, 0.0, None, 1.0] and got[0][1] == [0.6, 0.8] and got[1][1] is None
    assert round(got[0][2], 6) == 0.96 and got[1][2] is None and got[2][2] is None and got[3][2] is None


def test_models(rows):
    table = rows([(1, "ok", 0.5), (2, "bad", 0.5), (3, None, 0.5), (4, "ok", 0.9), (5, "ok", None)], "id int, t string, c double")

    def factory():
        seen = []

        def model(t):
            seen.append(t)
            if t == "bad":
                raise ValueError(f"call {len(seen)}")
            return t.upper()

        return model

    got = annotate.routed(table.coalesce(1), F.col("c") < 0.85, lambda df: annotate.call_model(df, "t", factory, 3, lambda s: None)).collect()
    by = {r.id: (r.answer, r.failure) for r in got}
    assert by == {1: ("OK", None), 2: (None, "ValueError: call 4"), 3: (None, None), 4: (None, None), 5: (None, None)}
    made = annotate.encode(table, "t", "v", annotate.hashed_words(8))
    again = annotate.encode(made.withColumn("v", F.when(F.col("id") == 1, F.array(F.lit(9.0).cast("float"))).otherwise(F.col("v"))), "t", "v", annotate.hashed_words(8)).collect()
    assert {r.id: None if r.v is None else len(r.v) for r in again} == {1: 1, 2: 8, 3: None, 4: 8, 5: 8}
    asked = table.limit(1).select(annotate.prompt("Which?", F.col("t"), F.array(F.lit("a"), F.lit("b"))).alias("p")).collect()[0].p
    assert asked == "Which?\nok\n1. a\n2. b"


def test_rows_by_place_and_status(rows):
    table = rows([(i, "approved" if i % 2 else "") for i in range(10)], "o long, s string")
    assert sorted(r.o for r in curate.offset_rows(table, "o", 4, 3).collect()) == [4, 5, 6]
    with pytest.raises(Exception, match="out of range"):
        curate.offset_rows(table, "o", 10).collect()
    with pytest.raises(ValueError):
        curate.offset_rows(table, "o", -1)
    assert curate.only_approved(table, "s", "approved").count() == 5
    assert curate.only_approved(table.filter("s = ''"), "s", "approved").count() == 5 and curate.only_approved(table.limit(0), "s", "approved").count() == 0
    old, new = rows([(1, 1, "a", "x")], "k int, o int, v string, f string"), rows([(1, 2, "b", "y"), (2, 1, "c", "z")], "k int, o int, v string, f string")
    assert sorted(map(tuple, curate.upsert(old, new, "k", "o", ("f",)).collect())) == [(1, 2, "b", "x"), (2, 1, "c", "z")]
    assert sorted(r.s for r in curate.updated(table.limit(2), F.col("o") == 1, {"s": F.lit("x")}).collect()) == ["", "x"]


def test_names(rows):
    assert values(rows, rules.titled(F.col("t")), ["hoi_gia_3ml", "a1b", None]) == ["Hoi Gia 3Ml", "A1B", None]
    assert values(rows, rules.level_one(F.col("t")), ["Truoc Ban", "trước bán", " khac ", None]) == ["truoc_mua_hang", "truoc_mua_hang", "khac", ""]
    assert values(rows, rules.picked_name(F.col("t"), F.lit("b"), F.lit("c_d")), ["x", "b", "c_d", " ", None]) == ["x", "C D", "C D", "C D", "C D"]


def test_free_numbers(rows):
    import random

    random.seed(1)
    used = random.sample(range(100, 400), 120) + [10**8]
    lacking = rows([(f"{i:04}",) for i in range(150)], "t string").withColumn("b", F.substring("t", 1, 2))
    got = [r.k for r in taxonomy.free_numbers(lacking, rows([(u,) for u in used], "k long"), ["t"], ["b"]).orderBy("t").collect()]
    assert got == [k for k in range(taxonomy.FIRST_NEW, 1000) if k not in set(used)][:150]


def test_configuration():
    from annolake.config import Config, from_environment

    assert from_environment({}) == Config()
    read = from_environment({"FORCE_REEMBED": "1", "OPENAI_MAX_RETRIES": "5", "HUMAN_REVIEW_QA_STATUSES": "a, b,", "OPENAI_TEMPERATURE": " "})
    assert (read.force_reembed, read.openai_max_retries, read.human_review_qa_statuses, read.openai_temperature) == (True, 5, frozenset({"a", "b"}), 0.0)
    with pytest.raises(ValueError):
        from_environment({"OPENAI_MAX_RETRIES": "x"})
