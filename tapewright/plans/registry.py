"""Query registry: a name, a Spark callable (spark, sf_dir) and, where SQL can express it, a statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise KeyError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def rounded(*names: str, digits: int = 6) -> list[Column]:
    """Columns rounded for comparison; adding zero removes a negative zero."""
    return [(F.round(name, digits) + 0).alias(name) for name in names]


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)
