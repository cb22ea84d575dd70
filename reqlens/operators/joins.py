"""Join helpers. Broadcasts are left to Spark, which checks the real size of each side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys."""
    renamed = {key: f"_right_{key}" for key in keys}
    other = right.withColumnsRenamed(renamed)
    condition = all_of([F.col(key).eqNullSafe(F.col(renamed[key])) for key in keys])
    return left.join(other, condition, how).drop(*renamed.values())


def members(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows whose value occurs in a list of values."""
    return df.join(values.select(column).distinct(), column, "left_semi")


def join_with_zero_fill(dimension: DataFrame, metrics: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Every dimension row; counts are zero where no metric exists, other measures stay null."""
    return dimension.join(metrics, key, "left").fillna(0, list(counts))
