"""Counts, top-k, ranks and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered(df: DataFrame, *spec: tuple[str, str]) -> DataFrame:
    """Mixed-direction sort; nulls last both ways."""
    return df.orderBy(*[F.desc_nulls_last(name) if way == "desc" else F.asc_nulls_last(name) for name, way in spec])


def count_by(df: DataFrame, *keys: str, name: str = "complaints", drop_null_keys: bool = True) -> DataFrame:
    if drop_null_keys:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_counts(df: DataFrame, key: str, n: int, name: str = "complaints") -> DataFrame:
    """Most frequent values; ties by value."""
    return count_by(df, key, name=name).orderBy(F.desc(name), F.asc(key)).limit(n)


def fixed_domain_counts(df: DataFrame, key: str, domain: Sequence, name: str = "complaints") -> DataFrame:
    """One row per domain value, zero when absent; values outside the domain fall away."""
    values = F.array(*[F.lit(value) for value in domain])
    listed = df.sparkSession.range(1).select(F.explode(values).alias(key))
    return listed.join(count_by(df, key, name=name), key, "left").fillna(0, [name])


def first_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of each group; the order must be total for a stable result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def rank_view(df: DataFrame, metric: str, n: int, ties: Sequence[str], min_rows: int = 0,
              count: str = "complaints", ascending: bool = False) -> DataFrame:
    """Best ``n`` rows of a scorecard by a chosen metric, among rows of enough volume."""
    way = F.asc_nulls_last if ascending else F.desc_nulls_last
    return df.where(F.col(count) >= min_rows).orderBy(way(metric), *[F.asc_nulls_last(t) for t in ties]).limit(n)


def gap_ranking(df: DataFrame, level: str, min_rows: int, n: int, ties: Sequence[str], faster: bool = False) -> DataFrame:
    """Cells slowest (or fastest) against their benchmark inside one issue level."""
    way = F.asc_nulls_last if faster else F.desc_nulls_last
    cells = df.where((F.col("issue_level") == level) & (F.col("complaints") >= min_rows))
    return cells.orderBy(way("median_resolution_gap_days"), way("unresolved_share_gap"),
                         *[F.asc_nulls_last(t) for t in ties]).limit(n)


def slower_cells(df: DataFrame, level: str, min_rows: int, n: int, ties: Sequence[str]) -> DataFrame:
    """Cells above their benchmark, by gap and then volume."""
    cells = df.where((F.col("issue_level") == level) & (F.col("complaints") >= min_rows)
                     & (F.col("median_resolution_gap_days") > 0))
    return cells.orderBy(F.desc("median_resolution_gap_days"), F.desc("complaints"),
                         *[F.asc_nulls_last(t) for t in ties]).limit(n)


def extreme(df: DataFrame, by: Column, *ties: str) -> DataFrame:
    """The single row with the largest value."""
    return df.orderBy(by.desc_nulls_last(), *[F.asc_nulls_last(t) for t in ties]).limit(1)


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "average_rank") -> DataFrame:
    """Descending rank in which ties share the mean of their positions; nulls are not ranked.

    Meant for scorecards: one row per area, board or type.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    ties = Window.partitionBy(*keys, value)
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), rank))


def share_within(df: DataFrame, keys: Sequence[str], value: str, total: str, share: str) -> DataFrame:
    whole = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(total, whole).withColumn(share, F.col(value) / F.col(total))


def pivot_wide(df: DataFrame, index: Sequence[str] | str, column: str, values: Mapping | Sequence, cell: str,
               fill: float | None = None) -> DataFrame:
    """Long to wide; the column values are stated, so no job runs to discover them."""
    names = values if isinstance(values, Mapping) else {value: str(value) for value in values}
    index = [index] if isinstance(index, str) else list(index)
    cells = [F.first(F.when(F.col(column) == value, F.col(cell)), ignorenulls=True).alias(name)
             for value, name in names.items()]
    wide = df.groupBy(*index).agg(*cells)
    return wide.fillna(fill, list(names.values())) if fill is not None else wide


def reindex(df: DataFrame, key: str, order: Sequence) -> DataFrame:
    """Exactly the stated rows, in order; absent ones are null."""
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in order])).alias("_at", key))
    return listed.join(df, key, "left").orderBy("_at").drop("_at")


def unpivot_named(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def clip_upper(df: DataFrame, column: str, bound: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.least(F.col(column), bound)))


def winsor_scale(df: DataFrame, column: str, name: str, low: float = 0.05, high: float = 0.95,
                 fill: float = 0.25, reverse: bool = False) -> DataFrame:
    """Scale to 0..1 between two quantiles of the column; a flat column scales to one half.

    For scorecards (one row per area or board): the quantiles come from one scalar subquery.
    """
    bounds = df.agg(F.struct(
        F.percentile(column, F.lit(low)).alias("low"), F.percentile(column, F.lit(high)).alias("high")).alias("b")).scalar()
    low_bound, span = F.col("_b.low"), F.col("_b.high") - F.col("_b.low")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - low_bound) / F.nullif(span, F.lit(0.0))))
    value = F.when(span > 0, F.when(F.col(column).isNotNull(), scaled)).when(span <= 0, F.lit(0.5))
    value = F.coalesce(value, F.lit(fill))
    return df.withColumn("_b", bounds).withColumn(name, 1 - value if reverse else value).drop("_b")


def scaled_radius(df: DataFrame, column: str, name: str, smallest: int = 800, largest: int = 8000) -> DataFrame:
    scaled = winsor_scale(df, column, name, low=0.1, high=0.95, fill=0.2)
    return scaled.withColumn(name, F.lit(float(smallest)) + F.col(name) * F.lit(float(largest - smallest)))


def minmax_scale(df: DataFrame, column: str, name: str, low: float, high: float) -> DataFrame:
    """Linear map of the column's range onto ``low..high``."""
    bounds = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("b")).scalar()
    width = F.nullif(F.col("_b.high") - F.col("_b.low"), F.lit(0.0))
    part = F.coalesce((F.col(column) - F.col("_b.low")) / width, F.lit(0.0))
    value = F.when(F.col(column).isNotNull(), F.lit(float(low)) + part * F.lit(float(high - low)))
    return df.withColumn("_b", bounds).withColumn(name, value).drop("_b")
