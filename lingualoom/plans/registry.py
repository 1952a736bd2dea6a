"""Named queries over a data folder, and the SQL each is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def materialised(sql: str) -> str:
    """``sql`` with every common table expression computed once, in the order written, instead of merged into what uses it."""
    return sql if "RECURSIVE" in sql else re.sub(r"(\b\w+) AS \((?=SELECT|UNPIVOT)", r"\1 AS MATERIALIZED (", sql)


class Registry:
    """Queries by name in order of registration, with SQL where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Keep a query; ``sql`` may be the name of an earlier query whose SQL it shares."""

        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is there already")
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = self.oracles[sql] if sql in self.oracles else materialised(sql)
            return query

        return keep
