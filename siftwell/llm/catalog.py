"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

from siftwell.llm.common import Query

MODULES = ["bpe", "chat", "convtrie", "decontaminate", "jaccard", "language", "lines", "merkle", "quality", "substrings", "tokencount", "topk", "toxicity"]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= importlib.import_module(f"siftwell.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"siftwell.llm.{name}").ORACLES
    return found
