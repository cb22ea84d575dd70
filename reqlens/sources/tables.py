"""Parquet tables between stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def require_inputs(spark: SparkSession, paths: Sequence[str]) -> None:
    """Fail before any work starts, listing every missing input at once."""
    missing = []
    for path in paths:
        try:
            spark.read.parquet(path)
        except AnalysisException:
            missing.append(path)
    if missing:
        raise FileNotFoundError("Missing required inputs:\n" + "\n".join(missing))


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing required columns: {', '.join(missing)}")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    require_inputs(spark, [path])
    df = spark.read.parquet(path)
    if columns is None:
        return df
    require_columns(df, columns, path)
    return df.select(*columns)


def write_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def publish(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write every named table below one folder."""
    return {name: write_table(df, f"{folder.rstrip('/')}/{name}") for name, df in tables.items()}


def write_projection(spark: SparkSession, source: str, columns: Sequence[str], target: str) -> str:
    return write_table(read_table(spark, source, columns), target)


def assert_unique(df: DataFrame, key: str) -> None:
    """The cardinality check of a one-to-one join; stops at the first repeated key."""
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} is not unique, for example {repeated[0][key]!r}")


def keep_first(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest row in column order, so the choice is reproducible.

    ``min`` of a struct combines on the map side; a hot key never gathers its rows in a task.
    """
    values = [name for name in df.columns if name != key]
    if not values:
        return df.distinct()
    picked = df.groupBy(key).agg(F.min(F.struct(*values)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{name}").alias(name) for name in values])


def assemble_columns(sources: Sequence[DataFrame], columns: Sequence[str], key: str = "unique_key") -> DataFrame:
    """Gather the requested columns from several narrow tables, joined one-to-one on the key."""
    wanted = list(dict.fromkeys(columns))
    for source in sources:
        if set(wanted) <= set(source.columns):
            return source.select(*wanted)
    remaining = list(wanted)
    parts: list[DataFrame] = []
    for source in sources:
        chosen = [name for name in remaining if name in source.columns and name != key]
        if not chosen:
            continue
        remaining = [name for name in remaining if name not in chosen]
        parts.append((source, chosen))
    unresolved = [name for name in remaining if name != key]
    if unresolved:
        raise ValueError(f"Sources are missing required columns: {', '.join(sorted(unresolved))}")
    if any(key not in source.columns for source, _ in parts):
        raise ValueError("Requested columns span tables that cannot be joined: no common key.")
    frames = [keep_first(source.select(key, *chosen), key) for source, chosen in parts]
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.join(frame, key, "inner")
    return joined.select(*wanted)


def top_counts_sql(spark: SparkSession, view: str, column: str, since: str, limit: int = 10) -> DataFrame:
    """Group count over a registered view, largest first."""
    return spark.sql(
        f"""
        SELECT {column}, COUNT(*) AS complaints
        FROM {view}
        WHERE created_date >= TIMESTAMP_NTZ '{since}'
        GROUP BY {column}
        ORDER BY complaints DESC, {column} ASC NULLS LAST
        LIMIT {limit}
        """
    )
