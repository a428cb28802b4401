"""A set of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.session import table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, tables: str, operator: Callable[..., DataFrame], sql: str | None = None) -> None:
        """Register operator(*tables) as a query, with equal SQL if SQL can say it."""
        self.queries[name] = lambda spark, sf_dir: operator(*[table(spark, sf_dir, t) for t in tables.split()])
        if sql:
            self.sql[name] = sql
