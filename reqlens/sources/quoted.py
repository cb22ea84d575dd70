"""CSV extracts whose quoted values hold line breaks, read by many tasks a file.

A line belongs to a value that is still open if an odd number of quotes stands before it in its file. Pass one
counts the lines with an odd number of quotes per split; sums over a file's splits say how many stand before each
split. Pass two adds those before each line inside its split. Every record of several lines has two such lines, its
first and its last, so half their number is the record's number, across splits too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SPLIT = ["file", "split"]
CSV = {"quote": '"', "escape": '"', "multiLine": "true"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, is_first``: one row per CSV record, line breaks inside quotes kept (as ``\\n``).

    Quotes inside values are doubled and such values quoted, as writers of CSV do: a lone quote in an unquoted value
    would shift the count for the rest of its file. Only the lines of broken records are gathered, each record by itself; lines
    are dealt by split, which the session's split size bounds. An open quote that never ends takes the rest of its
    file, as for any reader. Blank lines between records are left out; empty files give no rows.
    """
    value = F.regexp_replace("value", "\r$", "")
    lines = spark.read.text(path, lineSep="\n").select(
        value.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*SPLIT).agg(F.sum("odd").alias("odds"), F.min("at").alias("first_at"))
    splits = splits.select(
        *SPLIT, F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias("before"),
        F.when(F.row_number().over(Window.partitionBy("file").orderBy("split")) == 1, F.col("first_at")).alias("first_at"))
    above = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(splits, SPLIT).select(
        "line", *SPLIT, "at", "odd", F.col("at").eqNullSafe(F.col("first_at")).alias("is_first"),
        (F.col("before") + F.coalesce(F.sum("odd").over(above), F.lit(0))).alias("before"))
    whole = (F.col("before") % 2 == 0) & (F.col("odd") == 0)
    broken = placed.where(~whole).groupBy("file", F.floor(F.col("before") / 2).alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("lines"), F.max("is_first").alias("is_first"))
    joined = broken.select(F.array_join(F.transform("lines", lambda part: part["line"]), "\n").alias("record"), "is_first")
    return placed.where(whole & (F.col("line") != "")).select(F.col("line").alias("record"), "is_first").unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-string scan; every file begins with the header, which names the columns."""
    names = spark.read.option("header", True).options(**CSV).csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    parsed = F.from_csv("record", schema, CSV).alias("row")
    return read_records(spark, path).where(~F.col("is_first")).select(parsed).select("row.*")
