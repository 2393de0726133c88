"""All queries of the core, and their SQL."""

from __future__ import annotations

from annolake.plans import graph, inventory, labels, labels_sql, quality, runs

MODULES = (quality, labels, graph, runs, inventory)
SQL = (quality, labels_sql, graph, runs, inventory)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in SQL for name, sql in m.ORACLES.items()}
