"""Register of runnable queries and the SQL texts they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named fixture views."""
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            text = sql.strip()
            if not views:
                ORACLES[name] = text
            elif text.upper().startswith("WITH RECURSIVE"):
                ORACLES[name] = "WITH RECURSIVE " + fixtures.ctes(*views)[5:] + ", " + text[len("WITH RECURSIVE"):].strip()
            elif text.upper().startswith("WITH "):
                ORACLES[name] = fixtures.ctes(*views) + ", " + text[5:].strip()
            else:
                ORACLES[name] = fixtures.ctes(*views) + " " + text
        return function
    return add
