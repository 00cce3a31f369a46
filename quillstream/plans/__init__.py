"""Registered queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("trees", "identity", "texts", "listings")


def registered() -> tuple[dict, dict]:
    """All core queries and SQL texts, in module order."""
    found, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        found.update(module.QUERIES)
        sql.update(module.SQL)
    return found, sql
