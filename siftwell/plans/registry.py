"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named SQL building block that oracles may refer to."""
    VIEWS[name] = textwrap.dedent(sql).strip()


def query(name: str, sql: str | None = None):
    """Register a query; with ``sql``, also its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return register


def _needed(sql: str, seen: list[str], above: tuple[str, ...] = ()) -> list[str]:
    for name in VIEWS:
        if name not in seen and name not in above and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen, (*above, name))
            seen.append(name)
    return seen


def oracle(name: str) -> str:
    """The oracle SQL with the views it uses as leading CTEs."""
    sql = ORACLES[name]
    used = _needed(sql, [])
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in used)
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
