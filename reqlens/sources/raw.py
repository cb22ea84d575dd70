"""Raw request extracts: CSV in, year-partitioned parquet out."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqlens.contracts import RAW_DATE_COLUMNS, RAW_DATE_FORMAT, STORED_DATE_FORMAT
from reqlens.functions.cleaning import rerender_date
from reqlens.sources.quoted import read_quoted_csv


def normalize_name(name: str) -> str:
    """Letters and digits in lower case, every other run of characters one underscore."""
    return re.sub(r"[\W_]+", "_", name).strip("_").lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(name) for name in df.columns])


def parse_dates(
    df: DataFrame,
    columns: Sequence[str] = RAW_DATE_COLUMNS,
    source_format: str = RAW_DATE_FORMAT,
    target_format: str = STORED_DATE_FORMAT,
) -> DataFrame:
    """Re-render the date columns that exist; unparsable values become null."""
    present = {name: rerender_date(name, source_format, target_format) for name in columns if name in df.columns}
    return df.withColumns(present) if present else df


def read_raw(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All-string CSV scan with normalised header and dates.

    Files stay splittable. Set ``multi_line`` for extracts whose quoted values hold line breaks: these
    are read by many tasks a file too, at the price of a shuffle (``quoted``).
    """
    if multi_line:
        return parse_dates(normalize_columns(read_quoted_csv(spark, path)))
    df = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("quote", '"').option("escape", '"')
        .csv(path)
    )
    return parse_dates(normalize_columns(df))


def with_partition_year(df: DataFrame, created: str = "created_date") -> DataFrame:
    year = F.substring(F.col(created).cast("string"), 1, 4)
    return df.withColumn("created_year", F.coalesce(year, F.lit("unknown")))


def write_by_year(df: DataFrame, path: str, created: str = "created_date") -> None:
    """One folder per creation year.

    The rebalance hint gathers each year into few files, and lets adaptive execution split a
    year that holds most rows over many tasks instead of writing it from one.
    """
    (
        with_partition_year(df, created)
        .hint("rebalance", "created_year")
        .write.mode("overwrite").option("compression", "zstd")
        .partitionBy("created_year").parquet(path)
    )


def read_years(spark: SparkSession, path: str, years: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """Union of the year folders; other years are never listed for reading."""
    df = spark.read.option("basePath", path).parquet(path)
    df = df.where(F.col("created_year").cast("string").isin([str(year) for year in years]))
    return df.select(*columns) if columns else df
