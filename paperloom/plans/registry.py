"""Queries by name, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.tables import load as table  # noqa: F401  the query modules take it from here

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            name = query.__name__
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return keep


REGISTRY = Registry()
query = REGISTRY.add
