"""Registered queries: each runs library operators over whole tables and may state checking SQL."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name`` with the SQL that must give the same rows."""
    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def load() -> None:
    from catalogue import files, grids, population, settlements, shapes, tables  # noqa: F401
