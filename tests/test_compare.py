from pyspark.sql import functions as F

from annolake.operators.compare import diff, latest

FIELDS = ("a", "b")


def found(left, right):
    return sorted((r.key, r.finding, r.left_value, r.right_value) for r in diff(left, right, FIELDS, ("l", "r")).collect())


def test_findings(rows):
    left = rows([("k1", "x", 1), ("k2", "x", None), ("k3", "x", 2), ("k5", None, None)], "key string, a string, b int")
    right = rows([("k1", "x", 1), ("k2", "y", None), ("k4", "x", 2), ("k5", "v", 0)], "key string, a string, b int")
    assert found(left, right) == [("k2", "a", "x", "y"), ("k3", "missing_in_r", None, None), ("k4", "missing_in_l", None, None), ("k5", "a", None, "v"), ("k5", "b", None, "0")]


def test_empty_sides(rows):
    one = rows([("k", "x", 1)], "key string, a string, b int")
    none = one.limit(0)
    assert found(one, none) == [("k", "missing_in_r", None, None)]
    assert found(none, one) == [("k", "missing_in_l", None, None)]
    assert found(none, none) == []


def test_many_keys(rows):
    left = rows([(f"k{i}", "x", i) for i in range(3000)], "key string, a string, b int")
    right = left.filter("b % 7 <> 0").withColumn("b", F.when(F.col("b") % 10 == 3, -1).otherwise(F.col("b")))
    got = found(left, right)
    assert sum(f == "missing_in_r" for _, f, *_ in got) == len([i for i in range(3000) if i % 7 == 0])
    assert sum(f == "b" for _, f, *_ in got) == len([i for i in range(3000) if i % 7 and i % 10 == 3])


def test_latest(rows):
    table = rows([("a", 1, 1, "old"), ("a", 2, 2, "new"), ("a", None, 9, "none"), ("b", 5, 1, "x"), ("b", 5, 2, "tie"), (None, 1, 1, "y"), ("", 1, 1, "z")], "k string, at int, id int, v string")
    assert sorted(map(tuple, latest(table, F.col("k"), {"v": F.col("v")}, ("at", "id")).collect())) == [("a", "new"), ("b", "tie")]
    hot = rows([("h", i, i, str(i)) for i in range(5000)], "k string, at int, id int, v string")
    assert latest(hot, F.col("k"), {"v": F.col("v")}, ("at", "id")).collect()[0].v == "4999"
