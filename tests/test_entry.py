import importlib.util
import sys
from numbers import Number
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from annolake.plans import registry
from conftest import SMALL


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.queries()) <= set(queries)
    assert {f"p{n}_" for n in (1, 3)} <= {q[:3] for q in registry.queries()}
    if importlib.util.find_spec("annolake.llm"):
        assert {q.split("_")[0] for q in queries if q[0] == "p" and q[1].isdigit()} == {f"p{n}" for n in range(1, 11)}


def test_subpackage_that_cannot_be_imported(monkeypatch):
    monkeypatch.setitem(sys.modules, "annolake.llm.registry", None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracles())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample_id", "finding"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs_and_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.queries()[name](spark, SMALL).toPandas()
    if name not in registry.oracles():
        return
    db = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        db.sql(f"create view {file.stem} as from '{file}'")
    want = db.sql(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def shown(df):
        cell = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else round(float(v), 5) if isinstance(v, Number) else str(v)
        return sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

    assert shown(got) == shown(want)
