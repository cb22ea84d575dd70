"""Group summaries and the operations scorecards built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.contracts import BOARD_KEYS, DEFAULT_SCOPE, ISSUE_LEVELS, Scope
from reqlens.functions.lifecycle import year_type
from reqlens.functions.measures import modeled_subtype
from reqlens.operators.filters import aligned_ytd_cutoff
from reqlens.operators.joins import attach
from reqlens.operators.order_statistics import HOUR_OF_DAY, Tally, approximate_quantile, leading_labels, respread, summarize, tally

# Count column -> flag it counts.
OPERATIONS_COUNTS = {
    "resolved_complaints": "resolved_with_valid_date",
    "unresolved_complaints": "unresolved_flag",
    "status_backlog_complaints": "status_backlog_flag",
    "closed_status_missing_date_count": "closed_status_missing_date_flag",
    "nonclosed_status_has_date_count": "nonclosed_status_has_date_flag",
    "negative_resolution_count": "negative_resolution_flag",
    "mismatch_flagged_complaints": "potential_label_mismatch_flag",
}
EQUITY_COUNTS = {
    name: OPERATIONS_COUNTS[name] for name in
    ("resolved_complaints", "unresolved_complaints", "status_backlog_complaints", "mismatch_flagged_complaints")
}
# Count column -> share column.
SHARES = {
    "resolved_complaints": "resolved_share",
    "unresolved_complaints": "unresolved_share",
    "status_backlog_complaints": "status_backlog_share",
    "closed_status_missing_date_count": "closed_status_missing_date_share",
    "nonclosed_status_has_date_count": "nonclosed_status_has_date_share",
    "negative_resolution_count": "negative_resolution_share",
    "mismatch_flagged_complaints": "mismatch_flag_share",
}
MODELED_SUBTYPE = "modeled_subtype"  # label measure: the subtype of requests of a modelled family
DURATION_QUANTILES = {"median_resolution_days": 0.5, "p90_resolution_days": 0.9}


def resolved_days() -> Column:
    return F.when(F.col("resolved_with_valid_date"), F.col("resolution_days"))


def tally_requests(df: DataFrame, keys: Sequence[str] | Mapping[str, Column],
                   counts: Mapping[str, str] = OPERATIONS_COUNTS, bin_width: float | None = HOUR_OF_DAY) -> Tally:
    return tally(df, keys, {name: F.col(flag) for name, flag in counts.items()}, resolved_days(), bin_width)


def add_shares(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    return df.withColumns({SHARES[name]: F.col(name) / F.col("complaints") for name in counts})


def summarize_requests(tallied: Tally, keys: Sequence[str],
                       counts: Mapping[str, str] = OPERATIONS_COUNTS) -> DataFrame:
    totals = summarize(tallied, keys, "complaints", list(counts), DURATION_QUANTILES)
    return add_shares(totals, list(counts))


def group_summary(df: DataFrame, keys: Sequence[str], counts: Mapping[str, str] = OPERATIONS_COUNTS,
                  approx: bool = False) -> DataFrame:
    """Counts, shares, and exact median and 90th percentile of the valid resolution days.

    Null keys form groups of their own. ``approx`` trades exact quantiles for one shuffle.
    """
    if approx:
        quick = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("complaints"),
            *[F.count_if(F.col(flag)).alias(name) for name, flag in counts.items()],
            *[approximate_quantile(resolved_days(), q).alias(name) for name, q in DURATION_QUANTILES.items()],
        )
        return add_shares(quick, list(counts))
    return summarize_requests(tally_requests(df, keys, counts), keys, counts)


def label_measure(name: str) -> Column:
    return modeled_subtype() if name == MODELED_SUBTYPE else F.col(name)


def labelled_summary(df: DataFrame, keys: Sequence[str], modes: Mapping[str, str],
                     distinct: Mapping[str, str] | None = None,
                     counts: Mapping[str, str] = OPERATIONS_COUNTS) -> DataFrame:
    """``group_summary`` with the leading labels of the groups, all counted in one pass over the rows.

    Groups without a label have "Unknown" (a null modelled subtype) and no distinct label.
    """
    distinct = distinct or {}
    measures = dict.fromkeys([*modes.values(), *distinct.values()])
    tallied = tally(df, keys, {name: F.col(flag) for name, flag in counts.items()}, resolved_days(),
                    labels={name: label_measure(name) for name in measures})
    summary = attach(summarize_requests(tallied, keys, counts), leading_labels(tallied, keys, modes, distinct), keys)
    known = [name for name, measure in modes.items() if measure != MODELED_SUBTYPE]
    return summary.fillna("Unknown", known).fillna(0, list(distinct))


def agency_scorecard(df: DataFrame) -> DataFrame:
    return labelled_summary(df, ["agency", "agency_name"], {
        "top_complaint_type": "complaint_type",
        "top_issue_family": "issue_family",
        "top_resolution_outcome_group": "resolution_outcome_group",
        "top_modeled_subtype": MODELED_SUBTYPE,
    }, {"agencies_boroughs": "borough"}).withColumn("borough_coverage", F.col("agencies_boroughs"))


def type_scorecard(df: DataFrame) -> DataFrame:
    return labelled_summary(df, ["complaint_type"], {
        "top_agency": "agency",
        "top_issue_family": "issue_family",
        "top_resolution_outcome_group": "resolution_outcome_group",
        "top_modeled_subtype": MODELED_SUBTYPE,
    }, {"agencies_responding": "agency"})


def board_operations(df: DataFrame) -> DataFrame:
    return labelled_summary(df, BOARD_KEYS, {
        "top_agency": "agency",
        "top_complaint_type": "complaint_type",
        "top_issue_family": "issue_family",
        "top_modeled_subtype": MODELED_SUBTYPE,
    })


def operations_monthly(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    monthly = group_summary(df, ["created_month_start", "created_year"])
    return monthly.withColumns({
        "aligned_ytd_cutoff": aligned_ytd_cutoff(df, scope),
        "year_type": year_type(F.col("created_year"), scope),
    })


def segment_monthly(df: DataFrame, segment: str) -> DataFrame:
    return group_summary(df, ["created_month_start", "created_year", segment])


def by_issue_level(df: DataFrame, levels: Sequence[str] = ISSUE_LEVELS) -> DataFrame:
    """One row per request and issue level; the subtype level holds modelled subtypes only."""
    entries = []
    for level in levels:
        entry = F.struct(F.lit(level).alias("issue_level"), F.col(level).alias("issue_value"))
        entries.append(F.when(modeled_subtype().isNotNull(), entry) if level == "issue_subtype" else entry)
    exploded = df.withColumn("_entry", F.explode(F.array(*entries))).where(F.col("_entry").isNotNull())
    return exploded.withColumns({
        "issue_level": F.col("_entry.issue_level"), "issue_value": F.col("_entry.issue_value")}).drop("_entry")


def against_benchmark(df: DataFrame, cell_keys: Sequence[str], benchmark_keys: Sequence[str],
                      counts: Mapping[str, str], prefix: str, share_name: str,
                      levels: Sequence[str] = ISSUE_LEVELS) -> DataFrame:
    """Summary of every cell next to the summary of its benchmark, with gaps.

    Requests are counted once by all that the levels read; these counts are spread over the levels. Cells and
    benchmarks are rolled up from that one written tally; rows are read again only for bins whose ends do not
    settle a wanted position.
    """
    own = [key for key in cell_keys if key not in ("issue_level", "issue_value")]
    read = dict.fromkeys([*own, *levels, *(["subtype_modeled_flag"] if "issue_subtype" in levels else [])])
    tallied = respread(tally_requests(df, list(read), counts, bin_width=None), cell_keys, lambda rows: by_issue_level(rows, levels))
    cells = summarize_requests(tallied, cell_keys, counts)
    compared = [
        "complaints", "resolved_complaints", "unresolved_complaints", "status_backlog_complaints",
        "median_resolution_days", "p90_resolution_days", "resolved_share", "unresolved_share",
        "status_backlog_share",
    ]
    benchmark = summarize_requests(tallied, benchmark_keys, counts).select(
        *benchmark_keys, *[F.col(name).alias(f"{prefix}_{name}") for name in compared])
    gaps = {
        f"{measure}_gap{unit}": F.col(f"{measure}{unit}") - F.col(f"{prefix}_{measure}{unit}")
        for measure, unit in (("median_resolution", "_days"), ("p90_resolution", "_days"),
                              ("unresolved_share", ""), ("status_backlog_share", ""))
    }
    return attach(cells, benchmark, benchmark_keys).withColumns({
        share_name: F.col("complaints") / F.col(f"{prefix}_complaints"), **gaps})


def agency_issue_bottlenecks(df: DataFrame, levels: Sequence[str] = ISSUE_LEVELS) -> DataFrame:
    """Every agency inside every issue, against the issue as a whole."""
    cells = against_benchmark(
        df, ["issue_level", "issue_value", "agency", "agency_name"], ["issue_level", "issue_value"],
        OPERATIONS_COUNTS, "issue", "issue_volume_share", levels)
    slower = F.coalesce(F.col("median_resolution_gap_days") > 0, F.lit(False))
    return cells.withColumn("slower_than_issue_median_flag", slower)
