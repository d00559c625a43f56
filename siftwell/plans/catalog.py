"""All registered queries, in inventory order."""

from __future__ import annotations

import importlib

from siftwell.plans.registry import ORACLES, QUERIES, Query, oracle

MODULES = ["q_sources", "q_filters", "q_profiles", "q_windows", "q_functions", "q_survey", "q_state", "q_learning"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"siftwell.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return {name: QUERIES[name] for name in sorted(QUERIES)}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle(name) for name in sorted(ORACLES)}
