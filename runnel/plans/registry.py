"""A table of named queries."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, each with its SQL where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
