"""How query modules list their queries."""

from __future__ import annotations

from collections.abc import Callable


def listing() -> tuple[dict, dict, Callable]:
    """Two tables, of queries and of their SQL, and the decorator that fills them."""
    queries: dict = {}
    statements: dict = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                statements[f.__name__] = sql
            return f

        return add

    return queries, statements, query
