"""All registered queries of the core library: name -> (query, DuckDB twin or None)."""

from __future__ import annotations

MODULES: list[str] = ["relational", "windows", "scalars", "diversity", "statistics", "models", "inference"]


def _all() -> dict:
    import importlib

    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"varve.plans.{name}").QUERIES
    return found


def queries() -> dict:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _all().items() if s}
