"""Row filters. One-row lookups are scalar subqueries, so no join and no driver round trip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.contracts import DEFAULT_SCOPE, Scope

ONE_YEAR = "INTERVAL '1' YEAR"


def _latest(df: DataFrame, scope: Scope) -> DataFrame:
    return df.where(F.col("created_year") == scope.partial_year).agg(F.max("created_date").alias("latest"))


def aligned_ytd_cutoff(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> Column:
    """Last day of the partial year, at midnight; null when the year has no rows."""
    day = _latest(df, scope).select(F.date_trunc("DAY", "latest").cast("timestamp_ntz").alias("cutoff"))
    return day.scalar()


def filter_aligned_ytd(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Rows of both years up to the same calendar day.

    The cutoff is the midnight that starts the last day, so later rows of that day drop out.
    Without rows in the partial year both years are kept whole.
    """
    cutoff = aligned_ytd_cutoff(df, scope)
    months = 12 * (scope.partial_year - scope.base_year)
    shifted = F.add_months(cutoff, -months).cast("timestamp_ntz")
    year, created = F.col("created_year"), F.col("created_date")
    both = year.isin(scope.base_year, scope.partial_year)
    until = F.when(year == scope.base_year, shifted).otherwise(cutoff)
    return df.where(both & F.when(cutoff.isNull(), F.lit(True)).otherwise(created <= until))


def filter_aligned_exact(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Same windows with the exact last timestamp instead of its midnight."""
    latest = _latest(df, scope).scalar()
    created = F.col("created_date")

    def starts(year: int) -> Column:
        return F.lit(f"{year}-01-01").cast("timestamp_ntz")

    base = (created >= starts(scope.base_year)) & (created <= latest - F.expr(ONE_YEAR))
    partial = (created >= starts(scope.partial_year)) & (created <= latest)
    return df.where(base | partial)


def complete_month_cutoff(cutoff: Column) -> Column:
    """Start of the last month that is complete before the cutoff."""
    return F.add_months(F.trunc(cutoff, "MM"), -1).cast("timestamp_ntz")


def filter_complete_months(df: DataFrame, cutoff: Column, month: str = "created_month_start") -> DataFrame:
    return df.where(F.col(month) <= complete_month_cutoff(cutoff))


def aligned_complete_months(monthly: DataFrame, month: str = "created_month_start",
                            cutoff: str = "aligned_ytd_cutoff") -> DataFrame:
    """Months of every year whose month number is complete in the partial year.

    A January cutoff wraps to December and keeps everything; so does a missing cutoff.
    """
    last = monthly.agg(F.month(complete_month_cutoff(F.max(cutoff))).alias("m")).scalar()
    return monthly.where(F.when(last.isNull(), F.lit(True)).otherwise(F.month(month) <= last))


def modeled_subtypes(df: DataFrame) -> DataFrame:
    return df.where(F.col("subtype_modeled_flag") & (F.col("issue_subtype") != "not_modeled"))


def matched_areas(df: DataFrame) -> DataFrame:
    return df.where(F.col("zcta").isNotNull() & F.col("zcta_demographic_match_flag"))


def at_least(df: DataFrame, minimum: int, count: str = "complaints") -> DataFrame:
    return df.where(F.col(count) >= minimum)


def closure_text_scan(raw: DataFrame, families: Sequence[str], since: str,
                      type_column: str = "problem_formerly_complaint_type") -> DataFrame:
    """Keys and closure text of target families with non-blank text."""
    text = F.col("resolution_description")
    wanted = (
        (F.col("created_date").cast("timestamp_ntz") >= F.lit(since).cast("timestamp_ntz"))
        & F.col(type_column).isin(list(families))
        & text.isNotNull() & (F.trim(text) != "")
    )
    return raw.where(wanted).select("unique_key", "resolution_description")


def high_confidence_misses(predictions: DataFrame, threshold: float = 0.80) -> DataFrame:
    return predictions.where(~F.col("correct_prediction_flag") & (F.col("predicted_probability") >= threshold))
