"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the columns whose last bits depend on the order of floating-point operations."""
    return df.withColumns({name: F.round(name, digits) for name in columns})


DAYS = ("median_resolution_days", "p90_resolution_days")
