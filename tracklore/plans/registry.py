"""Query registry: a Spark plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class QuerySet:
    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def register(fn: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"query {name} registered twice")
            self.plans[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register
