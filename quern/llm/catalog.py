"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import quern.llm as package


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for m in sorted(x.name for x in pkgutil.iter_modules(package.__path__)):
        if m != "catalog":
            module = importlib.import_module(f"quern.llm.{m}")
            queries |= getattr(module, "QUERIES", {})
            sql |= getattr(module, "SQL", {})
    return queries, sql
