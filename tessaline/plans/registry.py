"""Named queries: a function of (spark, base folder) and, where SQL can say the same, its ANSI SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(run: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return run

        return add

    def merge(self, *others: Registry) -> Registry:
        for other in others:
            for name, run in other.queries.items():
                self.query(name, other.sql.get(name))(run)
        return self
