"""A module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def put(fn):
            queries[fn.__name__] = fn
            if text:
                sql[fn.__name__] = text
            return fn

        return put

    return queries, sql, query
