"""The registry of core queries: each name with its DataFrame function and the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "sampling", "composing", "tokens", "evaluation", "vectors", "results", "relational", "streams")


def _registry() -> dict:
    out: dict = {}
    for name in MODULES:
        for key, entry in importlib.import_module(f"quernel.queries.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = entry
    return out


def queries() -> dict:
    """Name -> function of (spark, folder)."""
    return {k: f for k, (f, _) in _registry().items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL, of the queries that SQL can state."""
    return {k: sql for k, (_, sql) in _registry().items() if sql}
