"""A table of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    """(queries, oracle, decorator that adds a query and its SQL)."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql:
                oracle[name] = sql
            return f

        return add

    return queries, oracle, query
