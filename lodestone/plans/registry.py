"""The library's queries by name: (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.sources.adapters import with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; its SQL may use the adapter views."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add

