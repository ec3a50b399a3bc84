"""The registry of queries and their SQL, by the problem or area they belong to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries and, where SQL can express them, the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"two queries named {key}")
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return add
