"""A catalogue of queries and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries, their SQL, and a decorator that registers a query under its function's name, with its SQL."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})
