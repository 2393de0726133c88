"""All queries of the subpackage, and their SQL."""

from __future__ import annotations

from annolake.llm import queries as q
from annolake.llm import sql


def queries() -> dict:
    return dict(q.QUERIES)


def oracles() -> dict[str, str]:
    return dict(sql.ORACLES)
