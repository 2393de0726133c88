import pytest
from pyspark.sql import functions as F

from annolake.llm.sampling import proportional_sample


def drawn(rows, data, targets, size, floor, **more):
    table = rows(data, "id long, label string").withColumn("available", F.lit(1))
    sample, report = proportional_sample(table, "id", F.col("label"), rows(targets, "category string, weight int"), size, floor, more.get("seed", 1))
    return sample.collect(), {r.category: r for r in report.collect()}


def test_shares(rows):
    data = [(i, "hot" if i % 3 else f"c{i % 5}") for i in range(6000)]
    sample, report = drawn(rows, data, [("hot", 50), ("c0", 30), ("c1", 20)], 300, 0)
    counts = {c: sum(r.drawn_as == c for r in sample) for c in ("hot", "c0", "c1")}
    assert len(sample) == len({r.id for r in sample}) == 300 and counts == {"hot": 150, "c0": 90, "c1": 60}
    assert report["c2"].status == "untargeted" and report["hot"].status == "met"
    again, _ = drawn(rows, data[::-1], [("hot", 50), ("c0", 30), ("c1", 20)], 300, 0)
    assert {r.id for r in again} == {r.id for r in sample}


def test_floors_and_unmet(rows):
    data = [(i, "big") for i in range(1000)] + [(2000 + i, "small") for i in range(5)] + [(3000, "rare"), (3001, None), (3002, "")]
    sample, report = drawn(rows, data, [("big", 960), ("small", 2), ("rare", 30), ("gone", 8), ("small", 0), (None, 4), ("zero", -3)], 100, 3)
    counts = {c: sum(r.drawn_as == c for r in sample) for c in report}
    assert counts == {"big": 96, "small": 3, "rare": 1, "gone": 0, "zero": 0, "": 0}
    assert (report["small"].status, report["rare"].status, report["gone"].status, report["zero"].status, report[""].status) == ("floor", "short", "absent", "untargeted", "untargeted")
    assert all(report[c].kept == n for c, n in counts.items())


def test_what_is_lacking_is_spread(rows):
    data = [(i, "a") for i in range(500)] + [(1000 + i, "b") for i in range(500)] + [(2000 + i, "c") for i in range(10)]
    sample, report = drawn(rows, data, [("a", 20), ("b", 10), ("c", 30), ("gone", 40)], 300, 0)
    counts = {c: sum(r.drawn_as == c for r in sample) for c in report}
    assert len(sample) == 300 and counts["c"] == 10 and counts["a"] in (193, 194) and counts["b"] in (96, 97)
    assert {c: report[c].status for c in report} == {"a": "above", "b": "above", "c": "short", "gone": "absent"}
    sample, _ = drawn(rows, data, [("a", 1), ("c", 1)], 5000, 0)
    assert len(sample) == 510  # all that have a target


def test_chances_of_rows(rows):
    """Over many starts, each row is drawn as often as its category's chance says."""
    data = [(i, "x") for i in range(12)] + [(100 + i, "y") for i in range(4)]
    seen = dict.fromkeys([i for i, _ in data], 0)
    for seed in range(16):
        sample, _ = drawn(rows, data, [("x", 3), ("y", 3)], 6, 0, seed=seed)
        assert len(sample) == 6 and sum(r.drawn_as == "x" for r in sample) == 3
        for r in sample:
            seen[r.id] += 1
    assert all(0 <= seen[i] <= 12 for i in range(12)) and sum(seen[i] for i in range(12)) == 48 and all(6 <= seen[100 + i] <= 16 for i in range(4))


def test_empty(rows):
    sample, report = drawn(rows, [], [("a", 1)], 10, 1)
    assert sample == [] and report["a"].status == "absent"
    sample, report = drawn(rows, [(1, "a")], [], 10, 1)
    assert sample == [] and report["a"].status == "untargeted"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chances(rows, seed):
    sample, _ = drawn(rows, [(i, f"c{i % 50}") for i in range(5000)], [(f"c{k}", 1) for k in range(50)], 75, 0, seed=seed)
    counts = [sum(r.drawn_as == f"c{k}" for r in sample) for k in range(50)]
    assert sum(counts) == 75 and set(counts) <= {1, 2}
