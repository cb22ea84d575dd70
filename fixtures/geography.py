"""Area, board and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import sql as S
from fixtures import views as V
from fixtures.registry import DAYS, query, rounded
from fixtures.sql import BASE, PARTIAL, with_
from reqlens.operators import geography, ranking, sampling, summaries

AREA_METRICS_SQL = f"""SELECT a.*, coalesce(m.complaints, 0) AS complaints, coalesce(m.unresolved_complaints, 0) AS unresolved_complaints,
  coalesce(m.geocoded_complaints, 0) AS geocoded_complaints, m.median_resolution_days, m.p90_resolution_days, m.unresolved_share, m.geocoded_share,
  CASE WHEN population > 0 THEN coalesce(m.complaints, 0) / population * 10000 END AS complaints_per_10k,
  CASE WHEN population > 0 THEN coalesce(m.unresolved_complaints, 0) / population * 10000 END AS unresolved_per_10k
FROM (SELECT zcta, zcta_name, population FROM areas UNION ALL SELECT '99999', 'nowhere', 10e0) a LEFT JOIN (
  SELECT incident_zip_clean AS zcta, count(*) AS complaints, count(*) FILTER (WHERE unresolved_flag) AS unresolved_complaints,
    count(*) FILTER (WHERE valid_coordinate_flag) AS geocoded_complaints,
    round(quantile_cont(resolution_days, 0.5) FILTER (WHERE resolved_with_valid_date), 6) AS median_resolution_days,
    round(quantile_cont(resolution_days, 0.9) FILTER (WHERE resolved_with_valid_date), 6) AS p90_resolution_days,
    count(*) FILTER (WHERE unresolved_flag) / CAST(count(*) AS DOUBLE) AS unresolved_share,
    count(*) FILTER (WHERE valid_coordinate_flag) / CAST(count(*) AS DOUBLE) AS geocoded_share
  FROM enriched GROUP BY 1) m USING (zcta)"""
AREA_CTES = S.ENRICHED + "," + S.AREAS


def _located(spark, sf):
    return V.enriched(spark, sf)


def _areas(spark, sf):
    areas = V.area_demographics(spark, sf).select("zcta", "zcta_name", "population")
    return areas.unionByName(spark.sql("SELECT '99999' AS zcta, 'nowhere' AS zcta_name, 10D AS population"))


@query("area_metrics", with_(AREA_CTES, AREA_METRICS_SQL))
def area_metrics(spark, sf):
    metrics = geography.area_metrics(_located(spark, sf), _areas(spark, sf))
    return rounded(metrics, *DAYS)


@query("area_rank_labels", with_(AREA_CTES + f", metrics AS ({AREA_METRICS_SQL})", """
    SELECT zcta, complaints, (r + (ties - 1) / 2.0) <= 8 AS label_flag FROM (
      SELECT *, rank() OVER (ORDER BY complaints_per_10k DESC NULLS LAST) AS r, count(*) OVER (PARTITION BY complaints_per_10k) AS ties
      FROM metrics WHERE complaints > 0 AND population >= 5000)"""))
def area_rank_labels(spark, sf):
    metrics = geography.area_metrics(_located(spark, sf), _areas(spark, sf))
    kept = metrics.where((F.col("complaints") > 0) & (F.col("population") >= 5000))
    ranked = ranking.average_rank(kept, "complaints_per_10k")
    return ranked.select("zcta", "complaints", (F.col("average_rank") <= 8).alias("label_flag"))


BOARD_KEYS = ["community_board", "community_board_borough", "community_board_code"]
BOARD_METRICS_SQL = f"""SELECT s.*, q.median_resolution_days, q.p90_resolution_days,
  unresolved_complaints / CAST(complaints AS DOUBLE) AS unresolved_share, geocoded_complaints / CAST(complaints AS DOUBLE) AS geocoded_share,
  modeled_subtype_complaints / CAST(complaints AS DOUBLE) AS modeled_subtype_share, mismatch_flagged_complaints / CAST(complaints AS DOUBLE) AS mismatch_flag_share,
  coalesce(t.top_complaint_type, 'Unknown') AS top_complaint_type, coalesce(u.top_issue_subtype, 'Unknown') AS top_issue_subtype,
  CASE WHEN s.community_board_borough IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY s.community_board_borough ORDER BY complaints DESC) AS DOUBLE) END AS borough_complaint_rank
FROM (SELECT {', '.join(BOARD_KEYS)}, count(*) AS complaints, count(*) FILTER (WHERE unresolved_flag) AS unresolved_complaints,
    count(*) FILTER (WHERE valid_coordinate_flag) AS geocoded_complaints, count(*) FILTER (WHERE subtype_modeled_flag) AS modeled_subtype_complaints,
    count(*) FILTER (WHERE potential_label_mismatch_flag) AS mismatch_flagged_complaints FROM enriched GROUP BY 1, 2, 3) s
LEFT JOIN (SELECT community_board, round(quantile_cont(resolution_days, 0.5), 6) AS median_resolution_days, round(quantile_cont(resolution_days, 0.9), 6) AS p90_resolution_days
  FROM enriched WHERE resolved_with_valid_date GROUP BY 1) q ON s.community_board = q.community_board
LEFT JOIN {S.mode_table('enriched', BOARD_KEYS, 'complaint_type', 'top_complaint_type')} t ON {S.same('s', 't', BOARD_KEYS)}
LEFT JOIN {S.mode_table('enriched', BOARD_KEYS, 'issue_subtype', 'top_issue_subtype')} u ON {S.same('s', 'u', BOARD_KEYS)}"""


@query("board_metrics", with_(S.ENRICHED, BOARD_METRICS_SQL))
def board_metrics(spark, sf):
    return rounded(geography.board_metrics(V.enriched(spark, sf)), *DAYS)


@query("board_leader_subtypes", with_(S.ENRICHED, f"""SELECT top_issue_subtype AS issue_subtype, count(*) AS boards FROM ({BOARD_METRICS_SQL})
    WHERE top_issue_subtype <> 'not_modeled' GROUP BY 1"""))
def board_leader_subtypes(spark, sf):
    return summaries.leader_counts(geography.board_metrics(V.enriched(spark, sf)))


BOARD_MONTHLY_SQL = """SELECT created_month_start, created_year, community_board, community_board_borough, count(*) AS complaints,
  count(*) FILTER (WHERE unresolved_flag) AS unresolved_complaints, count(*) FILTER (WHERE potential_label_mismatch_flag) AS mismatch_flagged_complaints,
  count(*) FILTER (WHERE unresolved_flag) / CAST(count(*) AS DOUBLE) AS unresolved_share,
  count(*) FILTER (WHERE potential_label_mismatch_flag) / CAST(count(*) AS DOUBLE) AS mismatch_flag_share
FROM enriched GROUP BY 1, 2, 3, 4"""


@query("board_monthly", with_(S.ENRICHED, BOARD_MONTHLY_SQL))
def board_monthly(spark, sf):
    return geography.board_monthly(V.enriched(spark, sf))


@query("board_ytd_change", with_(S.ENRICHED + f""", latest AS (SELECT max(created_date) AS last FROM enriched WHERE created_year = {PARTIAL}),
  kept AS (SELECT * FROM ({BOARD_MONTHLY_SQL}), latest WHERE community_board IS NOT NULL AND (
    (created_month_start >= TIMESTAMP '{BASE}-01-01' AND created_month_start <= date_trunc('month', last - INTERVAL 1 YEAR))
    OR (created_month_start >= TIMESTAMP '{PARTIAL}-01-01' AND created_month_start <= date_trunc('month', last))))""", f"""
  SELECT community_board, CAST(coalesce(sum(complaints) FILTER (WHERE created_year = {BASE}), 0) AS BIGINT) AS base_complaints,
    CAST(coalesce(sum(complaints) FILTER (WHERE created_year = {PARTIAL}), 0) AS BIGINT) AS partial_complaints,
    CAST(coalesce(sum(complaints) FILTER (WHERE created_year = {PARTIAL}), 0) - coalesce(sum(complaints) FILTER (WHERE created_year = {BASE}), 0) AS BIGINT) AS change
  FROM kept GROUP BY 1"""))
def board_ytd_change(spark, sf):
    df = V.enriched(spark, sf)
    latest = df.where(F.col("created_year") == PARTIAL).agg(F.max("created_date").alias("m")).scalar()
    return summaries.board_ytd_change(geography.board_monthly(df), latest, V.SCOPE)


# Grid ----------------------------------------------------------------------------

GRID = S.ENRICHED + """,
binned AS (SELECT *, CAST(floor((longitude - (-74.28e0)) / 0.1e0) AS INTEGER) AS grid_lon_bin, CAST(floor((latitude - 40.49e0) / 0.1e0) AS INTEGER) AS grid_lat_bin
  FROM enriched WHERE valid_coordinate_flag),
placed AS (SELECT *, CAST(grid_lon_bin AS VARCHAR) || ':' || CAST(grid_lat_bin AS VARCHAR) AS grid_id, -74.28e0 + grid_lon_bin * 0.1e0 AS grid_lon_min, 40.49e0 + grid_lat_bin * 0.1e0 AS grid_lat_min FROM binned),
grid AS (SELECT created_month_start, grid_id, grid_lon_bin, grid_lat_bin, grid_lon_min, grid_lat_min, grid_lon_min + 0.1e0 AS grid_lon_max, grid_lat_min + 0.1e0 AS grid_lat_max,
    count(*) AS complaints, count(*) FILTER (WHERE unresolved_flag) AS unresolved_complaints, count(*) FILTER (WHERE unresolved_flag) / CAST(count(*) AS DOUBLE) AS unresolved_share
  FROM placed GROUP BY ALL),
hot AS (SELECT grid.*, complaints >= threshold AS is_hotspot FROM grid JOIN (SELECT created_month_start, quantile_cont(complaints, 0.9) AS threshold FROM grid GROUP BY 1) USING (created_month_start))"""


@query("grid_bins", with_(GRID, "SELECT unique_key, grid_id, grid_lon_bin, grid_lat_bin, grid_lon_min, grid_lat_min, grid_lon_min + 0.1e0 AS grid_lon_max, grid_lat_min + 0.1e0 AS grid_lat_max FROM placed"))
def grid_bins(spark, sf):
    return geography.assign_grid_bins(_located(spark, sf), V.GRID).select(
        "unique_key", "grid_id", "grid_lon_bin", "grid_lat_bin", "grid_lon_min", "grid_lat_min", "grid_lon_max", "grid_lat_max")


@query("grid_monthly", with_(GRID, "SELECT * FROM grid"))
def grid_monthly(spark, sf):
    return geography.grid_monthly(_located(spark, sf), V.GRID)


@query("grid_persistence", with_(GRID, """SELECT grid_id, grid_lon_bin, grid_lat_bin, grid_lon_min, grid_lon_max, grid_lat_min, grid_lat_max,
    CAST(sum(complaints) AS BIGINT) AS total_complaints, CAST(sum(unresolved_complaints) AS BIGINT) AS total_unresolved_complaints,
    count(*) FILTER (WHERE is_hotspot) AS hotspot_months, count(*) AS active_months,
    count(*) FILTER (WHERE is_hotspot) / CAST(count(*) AS DOUBLE) AS hotspot_month_share,
    CAST(sum(unresolved_complaints) AS DOUBLE) / CAST(sum(complaints) AS DOUBLE) AS unresolved_share,
    (grid_lon_min + grid_lon_max) / 2 AS longitude, (grid_lat_min + grid_lat_max) / 2 AS latitude
    FROM hot GROUP BY ALL"""))
def grid_persistence(spark, sf):
    monthly = geography.grid_monthly(_located(spark, sf), V.GRID)
    return geography.grid_persistence(monthly).drop("geometry_wkt")


@query("hotspot_monthly", with_(GRID, """SELECT created_month_start, count(*) FILTER (WHERE is_hotspot) AS hotspot_cells,
    CAST(coalesce(sum(complaints) FILTER (WHERE is_hotspot), 0) AS BIGINT) AS hotspot_complaints, CAST(sum(complaints) AS BIGINT) AS total_complaints,
    CAST(coalesce(sum(complaints) FILTER (WHERE is_hotspot), 0) AS DOUBLE) / CAST(sum(complaints) AS DOUBLE) AS hotspot_complaint_share,
    strftime(created_month_start, '%Y-%m') AS month_label FROM hot GROUP BY created_month_start"""))
def hotspot_monthly(spark, sf):
    return geography.hotspot_monthly(geography.grid_monthly(_located(spark, sf), V.GRID))


@query("hotspot_by_category", with_(GRID, """SELECT complaint_type, grid_id, complaints, boroughs FROM (
    SELECT complaint_type, grid_id, count(*) AS complaints, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(borough) FILTER (WHERE borough IS NOT NULL))), 1, 3), ', '), '') AS boroughs,
      row_number() OVER (PARTITION BY complaint_type ORDER BY count(*) DESC, grid_id) AS rn
    FROM placed WHERE complaint_type IN (SELECT complaint_type FROM placed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) GROUP BY 1, 2) WHERE rn <= 3"""))
def hotspot_by_category(spark, sf):
    return geography.hotspots_by_category(_located(spark, sf), "complaint_type", 3, 3, V.GRID)


@query("hotspot_by_subtype", with_(GRID, """SELECT issue_subtype, grid_id, complaints, boroughs FROM (
    SELECT issue_subtype, grid_id, count(*) AS complaints, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(borough) FILTER (WHERE borough IS NOT NULL))), 1, 3), ', '), '') AS boroughs,
      row_number() OVER (PARTITION BY issue_subtype ORDER BY count(*) DESC, grid_id) AS rn
    FROM placed WHERE subtype_modeled_flag AND issue_subtype IN (SELECT issue_subtype FROM placed WHERE subtype_modeled_flag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) GROUP BY 1, 2) WHERE rn <= 3"""))
def hotspot_by_subtype(spark, sf):
    from reqlens.operators.filters import modeled_subtypes

    return geography.hotspots_by_category(modeled_subtypes(V.enriched(spark, sf)), "issue_subtype", 4, 3, V.GRID)


@query("density_bins", with_(GRID, "SELECT grid_id, grid_lon_bin, grid_lat_bin, count(*) AS complaints FROM placed GROUP BY ALL"))
def density_bins(spark, sf):
    return geography.density_bins(_located(spark, sf), V.GRID)


COVERAGE_SQL = """SELECT borough, count(*) AS complaints, count(*) FILTER (WHERE valid_coordinate_flag) AS geocoded_complaints,
    count(*) FILTER (WHERE valid_coordinate_flag) / CAST(count(*) AS DOUBLE) AS geocoded_share FROM enriched WHERE borough IS NOT NULL GROUP BY 1"""


@query("borough_coverage", with_(S.ENRICHED, COVERAGE_SQL))
def borough_coverage(spark, sf):
    return geography.borough_coverage(_located(spark, sf))


@query("mean_geocoded_share", with_(S.ENRICHED, f"SELECT round(avg(geocoded_share), 6) AS mean_geocoded_share FROM ({COVERAGE_SQL})"))
def mean_geocoded_share(spark, sf):
    share = geography.borough_coverage(_located(spark, sf)).agg(F.avg("geocoded_share").alias("mean_geocoded_share"))
    return rounded(share, "mean_geocoded_share")


@query("borough_quality", with_(S.ENRICHED, """SELECT borough, count(*) AS complaints, round(avg(CAST(valid_coordinate_flag AS INT)), 6) AS geocoded_rate,
    round(avg(CAST(unresolved_flag AS INT)), 6) AS unresolved_rate, round(avg(CAST(subtype_modeled_flag AS INT)), 6) AS modeled_subtype_rate
    FROM enriched WHERE borough IS NOT NULL GROUP BY 1"""))
def borough_quality(spark, sf):
    return rounded(geography.borough_quality(V.enriched(spark, sf)), "geocoded_rate", "unresolved_rate", "modeled_subtype_rate")


_RATES = {"valid_coordinate_rate": "valid_coordinate_flag", "modeled_subtype_rate": "subtype_modeled_flag",
          "mismatch_flag_rate": "potential_label_mismatch_flag", "unresolved_rate": "unresolved_flag",
          "zip_present_rate": "incident_zip_clean IS NOT NULL", "community_board_present_rate": "community_board IS NOT NULL"}


@query("geo_profile", with_(S.ENRICHED, "SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM enriched " + " ".join(
    f"UNION ALL SELECT '{k}', round(avg(CAST(({v}) AS INT)), 6) FROM enriched" for k, v in _RATES.items())))
def geo_profile(spark, sf):
    return rounded(summaries.geo_profile(V.enriched(spark, sf)), "value")


@query("map_points", with_(AREA_CTES + f", metrics AS ({AREA_METRICS_SQL})", """SELECT zcta, complaints, complaints_per_10k, 'POINT (' || zcta || ' 0)' AS geometry_wkt
    FROM metrics WHERE right(zcta, 1) <> '4'"""))
def map_points(spark, sf):
    areas = _areas(spark, sf)
    shape = F.when(F.col("zcta").endswith("4"), F.lit(None)).otherwise(F.concat(F.lit("POINT ("), F.col("zcta"), F.lit(" 0)")))
    metrics = geography.area_metrics(_located(spark, sf), areas)
    return geography.map_points(metrics, areas.select("zcta", shape.alias("geometry_wkt")), "zcta", ["complaints", "complaints_per_10k"])


@query("point_sample", with_(S.ENRICHED, """SELECT longitude, latitude, complaint_type, issue_subtype FROM enriched
    WHERE valid_coordinate_flag ORDER BY md5(unique_key || ':42'), unique_key LIMIT 500"""))
def point_sample(spark, sf):
    return sampling.geocoded_sample(V.enriched(spark, sf), 500)
