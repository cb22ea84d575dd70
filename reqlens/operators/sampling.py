"""Seeded samples of an exact size, reproducible for any partitioning.

Rows are ordered by the md5 digest of ``key:seed``, which any SQL engine can repeat, and then by
the key. The cut that leaves exactly the wanted number of rows is an order statistic; the sample
itself is then a filter, so rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.contracts import TARGET
from reqlens.operators.order_statistics import cut_points

BUCKET_BITS = 16  # a multiple of four: whole hexadecimal digits


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _order(key: str, seed: int) -> Column:
    return F.struct(_digest(key, seed).alias("h"), F.col(key).alias("k"))


def _bucket(key: str, seed: int) -> Column:
    """Upper bits of the digest."""
    return F.conv(F.substring(_digest(key, seed), 1, BUCKET_BITS // 4), 16, 10).cast("bigint")


def _capped(size: int) -> Column:
    return F.least(F.lit(size).cast("bigint"), F.col("_total"))


def uniform_sample(df: DataFrame, size: int, key: str = "unique_key", seed: int = 42) -> DataFrame:
    """``size`` rows (all, if there are fewer), chosen by the hash of the key."""
    cut = cut_points(df, [], _bucket(key, seed), _order(key, seed), _capped(size)).select("cut").scalar()
    return df.where(_order(key, seed) <= cut)


def stratified_sample(df: DataFrame, size: int, target: str = TARGET, key: str = "unique_key",
                      seed: int = 42) -> DataFrame:
    """``size`` rows in which each class keeps its share.

    Every class gets its rounded share, at least one row; then rows are dropped or topped up
    at random until the size is exact. ``target`` is a class label: the counts read here and
    the table of cuts have one row per class.
    """
    counts = {row[target]: row["count"] for row in df.groupBy(target).count().collect()}
    total = sum(counts.values())
    if size <= 0 or total <= size:
        return df
    quota = {label: min(max(1, round(size * n / total)), n) for label, n in counts.items() if label is not None}
    position = F.lit(None).cast("bigint")
    for label, rows in quota.items():
        position = F.when(F.col(target) == label, F.lit(rows).cast("bigint")).otherwise(position)
    cuts = cut_points(df, [target], _bucket(key, seed), _order(key, seed), position).select(
        F.col(target).alias("_class"), F.col("cut").alias("_cut"))
    marked = df.join(cuts, F.col(target).eqNullSafe(F.col("_class")), "left").withColumn(
        "_late", F.when(_order(key, seed) <= F.col("_cut"), F.lit(0)).otherwise(F.lit(1)))
    if sum(quota.values()) == size:
        return marked.where("_late = 0").drop("_class", "_cut", "_late")
    # Picked rows come first, the others later, each in a second random order.
    order = F.struct(F.col("_late").alias("late"), _order(key, seed + 1).alias("o"))
    bucket = F.col("_late") * (1 << BUCKET_BITS) + _bucket(key, seed + 1)
    cut = cut_points(marked, [], bucket, order, _capped(size)).select("cut").scalar()
    return marked.where(order <= cut).drop("_class", "_cut", "_late")


def geocoded_sample(df: DataFrame, size: int = 75_000, condition: Column | str | None = None,
                    seed: int = 42) -> DataFrame:
    """Points of the density views."""
    points = df.where("valid_coordinate_flag")
    if condition is not None:
        points = points.where(condition)
    return uniform_sample(points, size, seed=seed).select("longitude", "latitude", "complaint_type", "issue_subtype")
