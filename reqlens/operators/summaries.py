"""Exploratory and serving summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.contracts import BUCKET_ORDER, DEFAULT_SCOPE, Scope
from reqlens.functions.lifecycle import month_label, year_label
from reqlens.functions.measures import modeled_subtype, rate_of, share
from reqlens.operators.filters import filter_aligned_exact, modeled_subtypes
from reqlens.operators.joins import attach, members
from reqlens.operators.order_statistics import grouped_quantiles, leading_labels, summarize, tally
from reqlens.operators.ranking import (
    clip_upper, count_by, first_per_group, fixed_domain_counts, share_within, top_counts)
from reqlens.operators.sampling import uniform_sample
from reqlens.operators.scorecards import resolved_days
from reqlens.operators.taxonomy import common_subtypes, labelled_only

QUALITY_FLAGS = {
    "resolved_with_valid_date": "resolved_with_valid_date",
    "closed_status_missing_date_count": "closed_status_missing_date_flag",
    "nonclosed_status_has_date_count": "nonclosed_status_has_date_flag",
    "negative_resolution_count": "negative_resolution_flag",
}


def with_year_label(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    return df.withColumn("year_label", year_label(F.col("created_year"), scope))


def with_month_label(df: DataFrame, month: str = "created_month_start") -> DataFrame:
    return df.withColumn("month_label", month_label(F.col(month)))


# Quality -------------------------------------------------------------------------


def quality_summary(df: DataFrame) -> DataFrame:
    """One row: volumes, quality counters, median valid resolution, latest request."""
    flags = {name: F.col(flag) for name, flag in QUALITY_FLAGS.items()}
    latest = df.agg(F.max("created_date").alias("latest")).scalar()
    totals = summarize(tally(df, [], flags, resolved_days()), [], "complaints", list(flags),
                       {"median_resolution_days": 0.5})
    return totals.withColumns({
        "resolved_with_valid_date_share": F.col("resolved_with_valid_date") / F.col("complaints"),
        "max_created_date": latest,
    })


def quality_checks(quality: DataFrame) -> DataFrame:
    """Long form of the quality counters with their share of all rows."""
    named = quality.select("complaints", *[
        F.col(column).alias(label) for label, column in (
            ("Closed status missing close date", "closed_status_missing_date_count"),
            ("Non-closed status with close date", "nonclosed_status_has_date_count"),
            ("Negative resolution interval", "negative_resolution_count"))])
    checks = [name for name in named.columns if name != "complaints"]
    return named.unpivot(["complaints"], checks, "check", "rows").select(
        "check", "rows", (F.col("rows") / F.col("complaints")).alias("share_of_total"))


def profile(df: DataFrame) -> DataFrame:
    """Metric/value listing of the analytic table, values as text."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.min("created_date").alias("date_min"), F.max("created_date").alias("date_max"),
        F.size(F.collect_set("complaint_type")).alias("complaint_types"), F.size(F.collect_set("agency")).alias("agencies"),
        F.count_if("is_closed_status").alias("closed_status_rows"),
        F.count_if(~F.col("has_closed_date")).alias("missing_closed_date_rows"),
        F.count_if("missing_coordinates_flag").alias("missing_coordinates_rows"),
        F.count_if("missing_borough_flag").alias("missing_borough_rows"),
        F.count_if("negative_resolution_flag").alias("negative_resolution_rows"),
        F.count_if("closed_status_missing_date_flag").alias("closed_status_missing_date_rows"),
        F.count_if("nonclosed_status_has_date_flag").alias("nonclosed_status_has_date_rows"),
    )
    texts = row.select(*[
        (F.date_format(name, "yyyy-MM-dd HH:mm:ss") if name.startswith("date_") else F.col(name).cast("string")).alias(name)
        for name in row.columns])
    return texts.unpivot([], row.columns, "metric", "value")


def rate_profile(df: DataFrame, rates: dict[str, Column]) -> DataFrame:
    """Metric/value listing of row count and rates."""
    row = df.agg(F.count(F.lit(1)).cast("double").alias("rows"), *[rate_of(c).alias(n) for n, c in rates.items()])
    return row.unpivot([], row.columns, "metric", "value")


GEO_RATES = {
    "valid_coordinate_rate": "valid_coordinate_flag", "modeled_subtype_rate": "subtype_modeled_flag",
    "mismatch_flag_rate": "potential_label_mismatch_flag", "unresolved_rate": "unresolved_flag",
}


def geo_profile(df: DataFrame) -> DataFrame:
    return rate_profile(df, {
        **{name: F.col(flag) for name, flag in GEO_RATES.items()},
        "zip_present_rate": F.col("incident_zip_clean").isNotNull(),
        "community_board_present_rate": F.col("community_board").isNotNull(),
    })


def text_overall(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("complaints"),
        rate_of(F.col("subtype_modeled_flag")).alias("modeled_share"),
        rate_of(F.col("potential_label_mismatch_flag")).alias("mismatch_share"),
        rate_of(F.col("resolution_outcome_group") != "no_resolution_text").alias("resolution_text_share"),
        rate_of(F.col("issue_subtype_confidence") == "high").alias("high_confidence_subtype_share"),
    )


# Counts --------------------------------------------------------------------------


def monthly_counts(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    return with_month_label(count_by(with_year_label(df, scope), "created_month_start", "year_label"))


def monthly_by_type(df: DataFrame, types: int = 12) -> DataFrame:
    leading = members(df, top_counts(df, "complaint_type", types), "complaint_type")
    return with_month_label(count_by(leading, "created_month_start", "complaint_type"))


def seasonal_counts(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    return count_by(with_year_label(df, scope), "created_season", "year_label")


def borough_mix(df: DataFrame, types: int = 8) -> DataFrame:
    leading = members(df, top_counts(df, "complaint_type", types), "complaint_type")
    return count_by(leading, "borough", "complaint_type")


def bucket_counts(df: DataFrame) -> DataFrame:
    filled = df.withColumn("resolution_bucket", F.coalesce("resolution_bucket", F.lit("Missing")))
    return fixed_domain_counts(filled, "resolution_bucket", [*BUCKET_ORDER, "Missing"])


def hourly_counts(df: DataFrame) -> DataFrame:
    return fixed_domain_counts(df, "created_hour", list(range(24)))


def sample_rows(df: DataFrame, n: int = 15) -> DataFrame:
    columns = ["created_date", "borough", "complaint_type", "descriptor", "status"]
    return uniform_sample(df.where(F.col("created_date").isNotNull()), n).select(*columns)


def top_within(df: DataFrame, key: str, value: str, n: int, leaders: int | None = None) -> DataFrame:
    """Most frequent values inside each key, optionally of the most frequent keys only."""
    kept = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    if leaders:
        kept = members(kept, top_counts(df, key, leaders), key)
    return first_per_group(count_by(kept, key, value), [key], n, F.desc("complaints"), F.asc(value))


def type_coverage(df: DataFrame) -> DataFrame:
    keys, shares = ["complaint_type"], {"subtype_modeled_share": "subtype_modeled_flag", "mismatch_share": "potential_label_mismatch_flag"}
    flags = {name: F.col(flag) for name, flag in shares.items()}
    known = {f"_known_{name}": F.col(flag).isNotNull() for name, flag in shares.items()}
    tallied = tally(df.where(F.col("complaint_type").isNotNull()), keys, {**flags, **known}, labels={
        "family": F.col("issue_family"), "subtype": F.when(F.col("subtype_modeled_flag"), F.col("issue_subtype"))})
    counted = summarize(tallied, keys, "complaints", [*flags, *known], {}).withColumns({
        name: share(F.col(name), F.col(f"_known_{name}")) for name in shares}).drop(*known)
    leaders = leading_labels(tallied, keys, {"top_issue_family": "family", "top_issue_subtype": "subtype"})
    return attach(counted, leaders, keys).fillna("Unknown", ["top_issue_family"])


def leader_counts(boards: DataFrame) -> DataFrame:
    """Number of boards led by each subtype."""
    led = boards.where(F.col("top_issue_subtype").isNotNull() & (F.col("top_issue_subtype") != "not_modeled"))
    return count_by(led.withColumnRenamed("top_issue_subtype", "issue_subtype"), "issue_subtype", name="boards")


def residual_counts(df: DataFrame) -> DataFrame:
    filled = df.withColumn("residual_cluster_label", F.coalesce("residual_cluster_label", F.lit("missing")))
    return count_by(filled, "residual_cluster_label")


# Durations -----------------------------------------------------------------------

DESCRIBE_QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


def describe_durations(df: DataFrame, keys: Sequence[str] = (), value: str = "resolution_days") -> DataFrame:
    """Count, mean, deviation, extremes and quantiles of valid resolution days."""
    resolved = df.where("resolved_with_valid_date")
    quantiles = grouped_quantiles(resolved, keys, value, DESCRIBE_QUANTILES, rows_as="count")
    aggregates = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    if not keys:
        row = resolved.agg(F.struct(*aggregates).alias("s")).scalar()
        return quantiles.withColumns({name: row[name] for name in ("mean", "std", "min", "max")})
    return quantiles.join(resolved.groupBy(*keys).agg(*aggregates), list(keys))


def duration_by(df: DataFrame, key: str, minimum: int = 0) -> DataFrame:
    """Volume, median and 90th percentile of valid durations for keys of enough volume."""
    resolved = df.where(F.col("resolved_with_valid_date") & F.col(key).isNotNull())
    stats = grouped_quantiles(resolved, [key], "resolution_days", {"median_days": 0.5, "p90_days": 0.9}, rows_as="volume")
    return stats.where(F.col("volume") >= minimum)


def clipped_durations(df: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Valid durations cut off at a high quantile, for distribution views."""
    resolved = df.where("resolved_with_valid_date")
    bound = grouped_quantiles(resolved, [], "resolution_days", {"bound": quantile}).select("bound").scalar()
    return clip_upper(resolved, "resolution_days", bound, "clipped_days")


def subtype_durations(df: DataFrame, minimum: int = 1000) -> DataFrame:
    """Durations of the common labelled subtypes."""
    common = members(df.where("resolved_with_valid_date"), common_subtypes(df, minimum), "issue_subtype")
    return grouped_quantiles(common, ["complaint_type", "issue_subtype"], "resolution_days",
                             {"median_days": 0.5, "p90_days": 0.9}, rows_as="complaints")


def outcomes_by_subtype(df: DataFrame, minimum: int = 1000, n: int = 3) -> DataFrame:
    common = members(df, common_subtypes(df, minimum), "issue_subtype")
    counts = count_by(common.where(F.col("resolution_outcome_group") != "no_resolution_text"),
                      "complaint_type", "issue_subtype", "resolution_outcome_group")
    return first_per_group(counts, ["complaint_type", "issue_subtype"], n,
                           F.desc("complaints"), F.asc("resolution_outcome_group"))


# Year over year ------------------------------------------------------------------


def ytd_volume(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Requests in both aligned windows and the relative change."""
    window = filter_aligned_exact(df, scope)
    return window.agg(
        F.count_if(F.col("created_year") == scope.base_year).alias("base_complaints"),
        F.count_if(F.col("created_year") == scope.partial_year).alias("partial_complaints"),
    ).withColumn("change", F.col("partial_complaints") / F.nullif(F.col("base_complaints"), F.lit(0)) - 1)


def board_ytd_change(monthly: DataFrame, latest: Column, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Requests per board in the aligned months of both years, and the difference."""
    month = F.col("created_month_start")
    last = F.date_trunc("MONTH", latest).cast("timestamp_ntz")
    shifted = F.date_trunc("MONTH", latest - F.expr("INTERVAL '1' YEAR")).cast("timestamp_ntz")

    def start(year: int) -> Column:
        return F.lit(f"{year}-01-01").cast("timestamp_ntz")

    base = (month >= start(scope.base_year)) & (month <= shifted)
    partial = (month >= start(scope.partial_year)) & (month <= last)
    kept = monthly.where((base | partial) & F.col("community_board").isNotNull())

    def total(year: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("created_year") == year, F.col("complaints"))), F.lit(0))

    return kept.groupBy("community_board").agg(
        total(scope.base_year).alias("base_complaints"), total(scope.partial_year).alias("partial_complaints"),
    ).withColumn("change", F.col("partial_complaints") - F.col("base_complaints"))


def mix_shift(df: DataFrame, scope: Scope = DEFAULT_SCOPE, minimum: int = 1000) -> DataFrame:
    """Share of each common subtype inside its family, base window against partial year."""
    common = members(filter_aligned_exact(df, scope), common_subtypes(df, minimum), "issue_subtype")
    period = F.when(F.col("created_year") == scope.partial_year, "partial").otherwise("base")
    counts = count_by(common.withColumn("period", period), "complaint_type", "issue_subtype", "period")
    shares = share_within(counts, ["complaint_type", "period"], "complaints", "family_period_total", "share_within_family")

    def part(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("period") == name, F.col("share_within_family"))), F.lit(0.0))

    return shares.groupBy("complaint_type", "issue_subtype").agg(
        part("base").alias("base_share"), part("partial").alias("partial_share"),
    ).withColumn("share_change", F.col("partial_share") - F.col("base_share")).withColumn(
        "share_change_pct_points", F.col("share_change") * 100)


# Headlines -----------------------------------------------------------------------


def qa_totals(monthly: DataFrame) -> DataFrame:
    names = ["closed_status_missing_date_count", "nonclosed_status_has_date_count", "negative_resolution_count"]
    return monthly.agg(*[F.sum(name).alias(name) for name in names])


def largest_hotspot_share(persistence: DataFrame) -> DataFrame:
    """Share of its active months in which the most persistent cell is a hotspot."""
    return persistence.agg(F.max("hotspot_month_share").alias("hotspot_month_share"))


def top_label_findings(df: DataFrame) -> DataFrame:
    """Largest labelled (family, subtype) pair."""
    counts = count_by(labelled_only(df), "complaint_type", "issue_subtype")
    return counts.orderBy(F.desc("complaints"), "complaint_type", "issue_subtype").limit(1)


def top_modeled_subtypes(df: DataFrame, n: int = 4) -> DataFrame:
    return top_counts(modeled_subtypes(df), "issue_subtype", n)
