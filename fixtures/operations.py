"""Operations scorecards, filters, calendar and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import sql as S
from fixtures import views as V
from fixtures.registry import DAYS, query, rounded
from fixtures.sql import BASE, PARTIAL, with_
from reqlens.functions import cleaning as C
from reqlens.operators import filters, frames, ranking, scorecards, summaries
from reqlens.contracts import BUCKET_ORDER, WEEKDAY_ORDER
from reqlens.functions.measures import rank_in

GAPS = ("median_resolution_gap_days", "p90_resolution_gap_days", "unresolved_share_gap", "status_backlog_share_gap")

AGENCY_SQL = S.scorecard(
    "enriched", ["agency", "agency_name"],
    {"top_complaint_type": "complaint_type", "top_issue_family": "issue_family",
     "top_resolution_outcome_group": "resolution_outcome_group"},
    extra=", count(DISTINCT borough) AS agencies_boroughs, count(DISTINCT borough) AS borough_coverage")


@query("agency_scorecard", with_(S.ENRICHED, AGENCY_SQL))
def agency_scorecard(spark, sf):
    return rounded(scorecards.agency_scorecard(V.enriched(spark, sf)), *DAYS)


TYPE_SQL = S.scorecard(
    "enriched", ["complaint_type"],
    {"top_agency": "agency", "top_issue_family": "issue_family", "top_resolution_outcome_group": "resolution_outcome_group"},
    extra=", count(DISTINCT agency) AS agencies_responding")


@query("type_scorecard", with_(S.ENRICHED, TYPE_SQL))
def type_scorecard(spark, sf):
    return rounded(scorecards.type_scorecard(V.enriched(spark, sf)), *DAYS)


BOARD = ["community_board", "community_board_borough", "community_board_code"]
BOARD_SQL = S.scorecard("enriched", BOARD, {
    "top_agency": "agency", "top_complaint_type": "complaint_type", "top_issue_family": "issue_family"})


@query("board_operations", with_(S.ENRICHED, BOARD_SQL))
def board_operations(spark, sf):
    return rounded(scorecards.board_operations(V.enriched(spark, sf)), *DAYS)


CUTOFF_SQL = f"(SELECT CAST(date_trunc('day', max(created_date)) AS TIMESTAMP) FROM enriched WHERE created_year = {PARTIAL})"
MONTHLY_SQL = S.summary(
    "enriched", ["created_month_start", "created_year"],
    extra=f", {CUTOFF_SQL} AS aligned_ytd_cutoff, CASE WHEN created_year = {PARTIAL} THEN 'YTD' ELSE 'full_or_aligned' END AS year_type")


@query("operations_monthly", with_(S.ENRICHED, MONTHLY_SQL))
def operations_monthly(spark, sf):
    return rounded(scorecards.operations_monthly(V.enriched(spark, sf), V.SCOPE), *DAYS)


@query("segment_monthly", with_(S.ENRICHED, S.summary("enriched", ["created_month_start", "created_year", "borough"])))
def segment_monthly(spark, sf):
    return rounded(scorecards.segment_monthly(V.enriched(spark, sf), "borough"), *DAYS)


LEVELS = S.LEVELS.replace("{source}", "enriched")
CELLS_SQL = S.benchmark("levels", ["issue_level", "issue_value", "agency", "agency_name"], ["issue_level", "issue_value"],
                        S.OPS, "issue", "issue_volume_share")
CELL_CTES = S.ENRICHED + "," + LEVELS + f", cells AS (SELECT *, coalesce(median_resolution_gap_days > 0, false) AS slower_than_issue_median_flag FROM ({CELLS_SQL}))"
ISSUE_DAYS = ("issue_median_resolution_days", "issue_p90_resolution_days")


def _bottlenecks(spark, sf):
    cells = scorecards.agency_issue_bottlenecks(V.enriched(spark, sf))
    return rounded(cells, *DAYS, *ISSUE_DAYS, *GAPS)


@query("agency_issue_bottlenecks", with_(CELL_CTES, "SELECT * FROM cells"))
def agency_issue_bottlenecks(spark, sf):
    return _bottlenecks(spark, sf)


GAP_COLUMNS = "issue_value, agency, complaints, median_resolution_gap_days, unresolved_share_gap"


def _gap_ranking_sql(way: str) -> str:
    return with_(CELL_CTES, f"""SELECT {GAP_COLUMNS} FROM cells WHERE issue_level = 'issue_subtype' AND complaints >= 20
        ORDER BY median_resolution_gap_days {way} NULLS LAST, unresolved_share_gap {way} NULLS LAST, issue_value, agency LIMIT 25""")


@query("gap_ranking_slower", _gap_ranking_sql("DESC"))
def gap_ranking_slower(spark, sf):
    top = ranking.gap_ranking(_bottlenecks(spark, sf), "issue_subtype", 20, 25, ["issue_value", "agency"])
    return top.select(*GAP_COLUMNS.split(", "))


@query("gap_ranking_faster", _gap_ranking_sql("ASC"))
def gap_ranking_faster(spark, sf):
    top = ranking.gap_ranking(_bottlenecks(spark, sf), "issue_subtype", 20, 25, ["issue_value", "agency"], faster=True)
    return top.select(*GAP_COLUMNS.split(", "))


@query("bottleneck_leaders", with_(CELL_CTES, f"""SELECT {GAP_COLUMNS} FROM cells
    WHERE issue_level = 'complaint_type' AND complaints >= 50 AND median_resolution_gap_days > 0
    ORDER BY median_resolution_gap_days DESC, complaints DESC, issue_value, agency LIMIT 12"""))
def bottleneck_leaders(spark, sf):
    top = ranking.slower_cells(_bottlenecks(spark, sf), "complaint_type", 50, 12, ["issue_value", "agency"])
    return top.select(*GAP_COLUMNS.split(", "))


@query("rank_view", with_(S.ENRICHED, f"""SELECT row_number() OVER (ORDER BY median_resolution_days DESC, complaints DESC, community_board) AS place,
    community_board, complaints, median_resolution_days, top_agency FROM ({BOARD_SQL}) WHERE complaints >= 500
    ORDER BY median_resolution_days DESC, complaints DESC, community_board LIMIT 12"""))
def rank_view(spark, sf):
    boards = rounded(scorecards.board_operations(V.enriched(spark, sf)), *DAYS)
    top = ranking.rank_view(boards.withColumn("_volume", -F.col("complaints")), "median_resolution_days", 12,
                            ["_volume", "community_board"], min_rows=500)
    place = F.row_number().over(ranking.Window.orderBy(F.desc("median_resolution_days"), "_volume", "community_board"))
    return top.select(place.cast("bigint").alias("place"), "community_board", "complaints", "median_resolution_days", "top_agency")


@query("slowest_type", with_(S.ENRICHED, f"""SELECT complaint_type, complaints, median_resolution_days FROM ({TYPE_SQL})
    ORDER BY median_resolution_days DESC NULLS LAST, complaint_type LIMIT 1"""))
def slowest_type(spark, sf):
    types = rounded(scorecards.group_summary(V.enriched(spark, sf), ["complaint_type"]), *DAYS)
    return ranking.extreme(types, F.col("median_resolution_days"), "complaint_type").select(
        "complaint_type", "complaints", "median_resolution_days")


# Filters -------------------------------------------------------------------------

ALIGNED = f"""cut AS (SELECT CAST(date_trunc('day', max(created_date)) AS TIMESTAMP) AS cutoff FROM analytic WHERE created_year = {PARTIAL}),
aligned AS (SELECT analytic.* FROM analytic, cut WHERE
  (created_year = {BASE} AND created_date <= cutoff - INTERVAL 1 YEAR) OR (created_year = {PARTIAL} AND created_date <= cutoff))"""


@query("aligned_ytd_filter", with_(S.ANALYTIC + "," + ALIGNED, "SELECT unique_key, created_date, created_year FROM aligned"))
def aligned_ytd_filter(spark, sf):
    return filters.filter_aligned_ytd(V.enriched(spark, sf), V.SCOPE).select("unique_key", "created_date", "created_year")


EXACT = f"""latest AS (SELECT max(created_date) AS last FROM analytic WHERE created_year = {PARTIAL}),
exact AS (SELECT analytic.* FROM analytic, latest WHERE
  (created_date >= TIMESTAMP '{BASE}-01-01' AND created_date <= last - INTERVAL 1 YEAR)
  OR (created_date >= TIMESTAMP '{PARTIAL}-01-01' AND created_date <= last))"""


@query("ytd_volume", with_(S.ANALYTIC + "," + EXACT, f"""SELECT count(*) FILTER (WHERE created_year = {BASE}) AS base_complaints,
    count(*) FILTER (WHERE created_year = {PARTIAL}) AS partial_complaints,
    round(count(*) FILTER (WHERE created_year = {PARTIAL}) / CAST(count(*) FILTER (WHERE created_year = {BASE}) AS DOUBLE) - 1, 6) AS change FROM exact"""))
def ytd_volume(spark, sf):
    return rounded(summaries.ytd_volume(V.enriched(spark, sf), V.SCOPE), "change")


COMPLETE = "date_trunc('month', cutoff) - INTERVAL 1 MONTH"


@query("complete_months", with_(S.ANALYTIC + "," + ALIGNED, f"""SELECT created_month_start, created_year, count(*) AS complaints
    FROM aligned, cut WHERE created_month_start <= {COMPLETE} GROUP BY created_month_start, created_year"""))
def complete_months(spark, sf):
    df = V.enriched(spark, sf)
    cutoff = filters.aligned_ytd_cutoff(df, V.SCOPE)
    kept = filters.filter_complete_months(filters.filter_aligned_ytd(df, V.SCOPE), cutoff)
    return ranking.count_by(kept, "created_month_start", "created_year")


MONTH_ROWS = f"""months AS (SELECT created_month_start, created_year, count(*) AS complaints FROM analytic GROUP BY 1, 2),
cut AS (SELECT date_trunc('day', max(created_date)) AS cutoff FROM analytic WHERE created_year = {PARTIAL})"""


@query("aligned_complete_months", with_(S.ANALYTIC + "," + MONTH_ROWS, f"""SELECT created_month_start, created_year, complaints,
    strftime(created_month_start, '%Y-%m') AS month_label FROM months, cut WHERE month(created_month_start) <= month({COMPLETE})"""))
def aligned_complete_months(spark, sf):
    df = V.enriched(spark, sf)
    monthly = ranking.count_by(df, "created_month_start", "created_year").withColumn(
        "aligned_ytd_cutoff", filters.aligned_ytd_cutoff(df, V.SCOPE))
    return summaries.with_month_label(filters.aligned_complete_months(monthly)).drop("aligned_ytd_cutoff")


@query("year_pivot", with_(S.ANALYTIC, f"""SELECT created_month,
    count(*) FILTER (WHERE created_year = {BASE}) AS base_complaints, count(*) FILTER (WHERE created_year = {PARTIAL}) AS partial_complaints
    FROM analytic WHERE created_year IN ({BASE}, {PARTIAL}) GROUP BY created_month"""))
def year_pivot(spark, sf):
    years = V.enriched(spark, sf).where(F.col("created_year").isin(BASE, PARTIAL))
    counts = ranking.count_by(years, "created_month", "created_year")
    return ranking.pivot_wide(counts, "created_month", "created_year",
                              {BASE: "base_complaints", PARTIAL: "partial_complaints"}, "complaints", fill=0)


# Cleaning and features -----------------------------------------------------------

CLEAN_COLUMNS = ["unique_key", "agency", "agency_name", "complaint_type", "descriptor", "additional_details", "status",
                 "borough", "council_district", "latitude", "longitude"]


@query("clean_requests", with_(S.ANALYTIC, f"SELECT * REPLACE (CAST(council_district AS DOUBLE) AS council_district) FROM (SELECT {', '.join(CLEAN_COLUMNS)} FROM cleaned)"))
def clean_requests(spark, sf):
    cleaned = V.analytic(spark, sf, text=True).select(*CLEAN_COLUMNS)
    return cleaned.withColumn("council_district", F.col("council_district").cast("double"))


CALENDAR_COLUMNS = ["unique_key", "created_year", "created_month", "created_month_start", "created_weekday", "created_hour", "created_season"]


@query("calendar_features", with_(S.ANALYTIC, f"SELECT {', '.join(CALENDAR_COLUMNS)} FROM analytic"))
def calendar_features(spark, sf):
    return V.analytic(spark, sf).select(*CALENDAR_COLUMNS)


LIFECYCLE_COLUMNS = ["unique_key", "is_closed_status", "has_closed_date", "missing_coordinates_flag", "missing_borough_flag",
                     "closed_status_missing_date_flag", "nonclosed_status_has_date_flag", "negative_resolution_flag",
                     "resolution_hours", "resolution_days", "resolved_with_valid_date", "resolution_bucket"]


@query("lifecycle_flags", with_(S.ANALYTIC, f"SELECT {', '.join(LIFECYCLE_COLUMNS)} FROM analytic"))
def lifecycle_flags(spark, sf):
    return V.analytic(spark, sf).select(*LIFECYCLE_COLUMNS)


PLACE_COLUMNS = ["unique_key", "incident_zip_clean", "community_board", "community_board_code", "community_board_borough", "valid_coordinate_flag"]


@query("place_fields", with_(S.ENRICHED, f"SELECT {', '.join(PLACE_COLUMNS)} FROM enriched"))
def place_fields(spark, sf):
    return frames.apply_defaults(V.analytic(spark, sf)).select(*PLACE_COLUMNS)


@query("enriched_defaults", with_(S.ENRICHED, """SELECT unique_key, issue_family, issue_subtype, subtype_modeled_flag,
    potential_label_mismatch_flag, resolution_outcome_group, unresolved_flag, status_backlog_flag FROM enriched"""))
def enriched_defaults(spark, sf):
    """The analytic table joined to its taxonomy by key, instead of labelled in place."""
    labels = V.labelled(spark, sf)
    return frames.enrich(V.analytic(spark, sf), labels).select(
        "unique_key", "issue_family", "issue_subtype", "subtype_modeled_flag", "potential_label_mismatch_flag",
        "resolution_outcome_group", "unresolved_flag", "status_backlog_flag")


@query("parse_dates", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS created_date,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS closed_date FROM events""")
def parse_dates(spark, sf):
    from reqlens.sources.raw import parse_dates as parse

    text = F.date_format("ts", "MM/dd/yyyy hh:mm:ss a")
    raw = V.table(V.prepare(spark), sf, "events").select(
        "event_id", text.alias("created_date"),
        F.when(F.col("event_id") % 7 == 0, F.lit("13/45/2024 99:00:00 XM")).otherwise(text).alias("closed_date"))
    return parse(raw)


@query("numeric_coercion", """SELECT unique_key, CAST(TRY_CAST(council_district AS BIGINT) AS DOUBLE) AS council_district, latitude FROM raw""".replace(
    "FROM raw", "FROM (WITH " + S.RAW.strip() + " SELECT * FROM raw)"))
def numeric_coercion(spark, sf):
    raw = V.raw_requests(spark, sf)
    return raw.select(F.col("unique_key").cast("string").alias("unique_key"), C.to_long("council_district").cast("double").alias("council_district"),
                      C.to_double("latitude").alias("latitude"))


# Counts --------------------------------------------------------------------------


@query("resolution_buckets", with_(S.ANALYTIC, f"""SELECT b AS resolution_bucket, count(unique_key) AS complaints
    FROM (SELECT unnest([{', '.join(S.quote(b) for b in [*BUCKET_ORDER, 'Missing'])}]) AS b)
    LEFT JOIN (SELECT unique_key, coalesce(resolution_bucket, 'Missing') AS rb FROM analytic) ON b = rb GROUP BY b"""))
def resolution_buckets(spark, sf):
    return summaries.bucket_counts(V.enriched(spark, sf))


@query("hourly_counts", """SELECT CAST(h AS INTEGER) AS created_hour, count(event_id) AS complaints FROM range(24) t(h)
    LEFT JOIN events ON hour(ts) = h GROUP BY h""")
def hourly_counts(spark, sf):
    events = V.table(V.prepare(spark), sf, "events")
    return summaries.hourly_counts(events.select(F.hour("ts").alias("created_hour")))


@query("weekday_hour", f"""SELECT dayname(ts) AS created_weekday, CAST(hour(ts) AS INTEGER) AS created_hour, count(*) AS complaints,
    CAST(isodow(ts) AS BIGINT) AS weekday_rank FROM events GROUP BY 1, 2, 4""")
def weekday_hour(spark, sf):
    events = V.table(V.prepare(spark), sf, "events").select(
        F.date_format("ts", "EEEE").alias("created_weekday"), F.hour("ts").alias("created_hour"))
    return ranking.count_by(events, "created_weekday", "created_hour").withColumn(
        "weekday_rank", rank_in("created_weekday", WEEKDAY_ORDER))


YEAR_LABEL = f"CASE WHEN created_year = {PARTIAL} THEN '{PARTIAL} YTD' ELSE CAST(created_year AS VARCHAR) END"


@query("monthly_counts", with_(S.ANALYTIC, f"""SELECT created_month_start, {YEAR_LABEL} AS year_label, count(*) AS complaints,
    strftime(created_month_start, '%Y-%m') AS month_label FROM analytic GROUP BY 1, 2, 4"""))
def monthly_counts(spark, sf):
    return summaries.monthly_counts(V.enriched(spark, sf), V.SCOPE)


@query("seasonal_counts", with_(S.ANALYTIC, f"SELECT created_season, {YEAR_LABEL} AS year_label, count(*) AS complaints FROM analytic GROUP BY 1, 2"))
def seasonal_counts(spark, sf):
    return summaries.seasonal_counts(V.enriched(spark, sf), V.SCOPE)


TOP_TYPES = "top AS (SELECT complaint_type FROM analytic GROUP BY 1 ORDER BY count(*) DESC, complaint_type LIMIT 3)"


@query("monthly_by_type", with_(S.ANALYTIC + "," + TOP_TYPES, """SELECT created_month_start, complaint_type, count(*) AS complaints,
    strftime(created_month_start, '%Y-%m') AS month_label FROM analytic WHERE complaint_type IN (FROM top) GROUP BY 1, 2, 4"""))
def monthly_by_type(spark, sf):
    return summaries.monthly_by_type(V.enriched(spark, sf), types=3)


@query("borough_mix", with_(S.ANALYTIC + "," + TOP_TYPES, """SELECT borough, complaint_type, count(*) AS complaints
    FROM analytic WHERE complaint_type IN (FROM top) AND borough IS NOT NULL GROUP BY 1, 2"""))
def borough_mix(spark, sf):
    return summaries.borough_mix(V.enriched(spark, sf), types=3)


@query("top_types", with_(S.ANALYTIC, "SELECT complaint_type, count(*) AS complaints FROM analytic GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4"))
def top_types(spark, sf):
    return ranking.top_counts(V.enriched(spark, sf), "complaint_type", 4)


@query("top_k_per_group", with_(S.ANALYTIC + "," + TOP_TYPES, """SELECT complaint_type, descriptor, complaints FROM (
    SELECT complaint_type, descriptor, count(*) AS complaints, row_number() OVER (PARTITION BY complaint_type ORDER BY count(*) DESC, descriptor) AS rn
    FROM analytic WHERE complaint_type IN (FROM top) GROUP BY 1, 2) WHERE rn <= 8"""))
def top_k_per_group(spark, sf):
    return summaries.top_within(V.enriched(spark, sf), "complaint_type", "descriptor", 8, leaders=3)


@query("top_details_per_type", with_(S.ANALYTIC, """SELECT complaint_type, additional_details, complaints FROM (
    SELECT complaint_type, additional_details, count(*) AS complaints, row_number() OVER (PARTITION BY complaint_type ORDER BY count(*) DESC, additional_details) AS rn
    FROM analytic WHERE additional_details IS NOT NULL GROUP BY 1, 2) WHERE rn <= 3"""))
def top_details_per_type(spark, sf):
    return summaries.top_within(V.enriched(spark, sf), "complaint_type", "additional_details", 3)


@query("top_counts_sql", with_(S.ANALYTIC, f"""SELECT borough, count(*) AS complaints FROM analytic
    WHERE created_date >= TIMESTAMP '{BASE}-01-01' GROUP BY borough ORDER BY 2 DESC, borough NULLS LAST LIMIT 4"""))
def top_counts_sql(spark, sf):
    from reqlens.sources.tables import top_counts_sql as run

    V.analytic(spark, sf).createOrReplaceTempView("reqlens_requests")
    return run(spark, "reqlens_requests", "borough", f"{BASE}-01-01 00:00:00", 4)


# Quality and durations -----------------------------------------------------------

QUALITY_SQL = """SELECT count(*) AS complaints, count(*) FILTER (WHERE resolved_with_valid_date) AS resolved_with_valid_date,
  count(*) FILTER (WHERE closed_status_missing_date_flag) AS closed_status_missing_date_count,
  count(*) FILTER (WHERE nonclosed_status_has_date_flag) AS nonclosed_status_has_date_count,
  count(*) FILTER (WHERE negative_resolution_flag) AS negative_resolution_count,
  round(quantile_cont(resolution_days, 0.5), 6) AS median_resolution_days,
  count(*) FILTER (WHERE resolved_with_valid_date) / CAST(count(*) AS DOUBLE) AS resolved_with_valid_date_share,
  max(created_date) AS max_created_date FROM analytic"""


@query("quality_summary", with_(S.ANALYTIC, QUALITY_SQL))
def quality_summary(spark, sf):
    return rounded(summaries.quality_summary(V.enriched(spark, sf)), "median_resolution_days")


@query("quality_checks", with_(S.ANALYTIC + f", q AS ({QUALITY_SQL})", """
    SELECT 'Closed status missing close date' AS "check", closed_status_missing_date_count AS "rows", closed_status_missing_date_count / CAST(complaints AS DOUBLE) AS share_of_total FROM q
    UNION ALL SELECT 'Non-closed status with close date', nonclosed_status_has_date_count, nonclosed_status_has_date_count / CAST(complaints AS DOUBLE) FROM q
    UNION ALL SELECT 'Negative resolution interval', negative_resolution_count, negative_resolution_count / CAST(complaints AS DOUBLE) FROM q"""))
def quality_checks(spark, sf):
    return summaries.quality_checks(summaries.quality_summary(V.enriched(spark, sf)))


_PROFILE = {
    "rows": "count(*)", "date_min": "strftime(min(created_date), '%Y-%m-%d %H:%M:%S')",
    "date_max": "strftime(max(created_date), '%Y-%m-%d %H:%M:%S')", "complaint_types": "count(DISTINCT complaint_type)",
    "agencies": "count(DISTINCT agency)", "closed_status_rows": "count(*) FILTER (WHERE is_closed_status)",
    "missing_closed_date_rows": "count(*) FILTER (WHERE NOT has_closed_date)",
    "missing_coordinates_rows": "count(*) FILTER (WHERE missing_coordinates_flag)",
    "missing_borough_rows": "count(*) FILTER (WHERE missing_borough_flag)",
    "negative_resolution_rows": "count(*) FILTER (WHERE negative_resolution_flag)",
    "closed_status_missing_date_rows": "count(*) FILTER (WHERE closed_status_missing_date_flag)",
    "nonclosed_status_has_date_rows": "count(*) FILTER (WHERE nonclosed_status_has_date_flag)",
}


@query("analytic_profile", with_(S.ANALYTIC, " UNION ALL ".join(
    f"SELECT '{k}' AS metric, CAST({v} AS VARCHAR) AS value FROM analytic" for k, v in _PROFILE.items())))
def analytic_profile(spark, sf):
    return summaries.profile(V.enriched(spark, sf))


@query("qa_totals", with_(S.ENRICHED, """SELECT count(*) FILTER (WHERE closed_status_missing_date_flag) AS closed_status_missing_date_count,
    count(*) FILTER (WHERE nonclosed_status_has_date_flag) AS nonclosed_status_has_date_count,
    count(*) FILTER (WHERE negative_resolution_flag) AS negative_resolution_count FROM enriched"""))
def qa_totals(spark, sf):
    return summaries.qa_totals(scorecards.operations_monthly(V.enriched(spark, sf), V.SCOPE))


DESCRIBE = """count(*) AS count, round(avg(resolution_days), 6) AS mean, round(stddev_samp(resolution_days), 6) AS std,
  round(min(resolution_days), 6) AS min, round(max(resolution_days), 6) AS max, round(quantile_cont(resolution_days, 0.5), 6) AS p50,
  round(quantile_cont(resolution_days, 0.9), 6) AS p90, round(quantile_cont(resolution_days, 0.95), 6) AS p95"""
DESCRIBED = ("mean", "std", "min", "max", "p50", "p90", "p95")


@query("describe_durations", with_(S.ANALYTIC, f"SELECT {DESCRIBE} FROM analytic WHERE resolved_with_valid_date"))
def describe_durations(spark, sf):
    return rounded(summaries.describe_durations(V.enriched(spark, sf)), *DESCRIBED)


@query("describe_durations_by_type", with_(S.ANALYTIC, f"SELECT complaint_type, {DESCRIBE} FROM analytic WHERE resolved_with_valid_date GROUP BY 1"))
def describe_durations_by_type(spark, sf):
    return rounded(summaries.describe_durations(V.enriched(spark, sf), ["complaint_type"]), *DESCRIBED)


@query("duration_by_borough", with_(S.ANALYTIC, """SELECT borough, count(*) AS volume, round(quantile_cont(resolution_days, 0.5), 6) AS median_days,
    round(quantile_cont(resolution_days, 0.9), 6) AS p90_days FROM analytic WHERE resolved_with_valid_date AND borough IS NOT NULL
    GROUP BY borough HAVING count(*) >= 100"""))
def duration_by_borough(spark, sf):
    return rounded(summaries.duration_by(V.enriched(spark, sf), "borough", 100), "median_days", "p90_days")


@query("clipped_durations", with_(S.ANALYTIC, """SELECT unique_key, round(least(resolution_days, (SELECT quantile_cont(resolution_days, 0.95) FROM analytic)), 6) AS clipped_days
    FROM analytic WHERE resolved_with_valid_date"""))
def clipped_durations(spark, sf):
    return rounded(summaries.clipped_durations(V.enriched(spark, sf)), "clipped_days").select("unique_key", "clipped_days")


@query("winsor_scale", with_(S.ENRICHED + f""", boards AS ({S.summary('enriched', BOARD)}),
    bounds AS (SELECT quantile_cont(median_resolution_days, 0.05) AS lo, quantile_cont(median_resolution_days, 0.95) AS hi,
      quantile_cont(complaints, 0.1) AS rlo, quantile_cont(complaints, 0.95) AS rhi FROM boards)""",
    """SELECT community_board, community_board_borough, community_board_code,
      round(CASE WHEN median_resolution_days IS NULL THEN 0.25 ELSE least(1, greatest(0, (median_resolution_days - lo) / (hi - lo))) END, 6) AS scaled,
      round(800 + least(1, greatest(0, (complaints - rlo) / (rhi - rlo))) * 7200, 6) AS radius FROM boards, bounds"""))
def winsor_scale(spark, sf):
    boards = rounded(scorecards.group_summary(V.enriched(spark, sf), BOARD), *DAYS)
    scaled = ranking.scaled_radius(ranking.winsor_scale(boards, "median_resolution_days", "scaled"), "complaints", "radius")
    return rounded(scaled.select(*BOARD, "scaled", "radius"), "scaled", "radius")


# Sources -------------------------------------------------------------------------


@query("closure_text_scan", "WITH " + S.RAW.strip() + f"""
    SELECT CAST(o_orderkey AS BIGINT) AS unique_key, resolution_description FROM raw
    WHERE created_date >= TIMESTAMP '{BASE}-01-01' AND complaint_type IN ('1-URGENT', '2-HIGH') AND trim(resolution_description) <> ''""")
def closure_text_scan(spark, sf):
    return filters.closure_text_scan(V.raw_requests(spark, sf, text=True), ["1-URGENT", "2-HIGH"], f"{BASE}-01-01 00:00:00")


@query("assemble_columns", """SELECT o_orderkey AS unique_key, o_orderstatus AS status, c_mktsegment AS agency, o_totalprice AS price
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def assemble_columns(spark, sf):
    from reqlens.sources.tables import assemble_columns as assemble

    orders, customer = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    first = orders.select(F.col("o_orderkey").alias("unique_key"), F.col("o_orderstatus").alias("status"))
    second = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("unique_key"), F.col("c_mktsegment").alias("agency"), F.col("o_totalprice").alias("price"))
    return assemble([first, second.unionByName(second)], ["unique_key", "status", "agency", "price"])
