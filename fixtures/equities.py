"""Demographic, quintile and matched-gap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import sql as S
from fixtures import views as V
from fixtures.operations import GAPS
from fixtures.registry import DAYS, query, rounded
from fixtures.sql import with_
from reqlens.contracts import AREA_REFERENCE_SCHEMA, CENSUS_VARIABLES, QUINTILE_COLUMNS
from reqlens.operators import collapsed, equity, filters, ranking
from reqlens.operators.summaries import with_month_label
from reqlens.session import cut_lineage
from reqlens.sources import areas

ATTRIBUTES = ["population", "median_household_income", "poverty_share", "renter_share", "nonwhite_share",
              "bachelors_or_higher_share", "median_gross_rent", "acs_missing_flag", *QUINTILE_COLUMNS]
ATTR = ", ".join(f"a.{c}" for c in ATTRIBUTES)


# What the equity operators read of the enriched table; every row of it.
REQUEST_COLUMNS = ["unique_key", "incident_zip", "borough", "community_board", "agency", "complaint_type", "descriptor", "issue_family", "issue_subtype",
                   "subtype_modeled_flag", "potential_label_mismatch_flag", "created_year", "created_month_start", "created_season",
                   "resolved_with_valid_date", "resolution_days", "unresolved_flag", "status_backlog_flag"]


def _frame(spark, sf):
    demographics = V.area_demographics(spark, sf)
    return equity.equity_frame(V.enriched(spark, sf, REQUEST_COLUMNS), demographics), demographics


QUINTILE_JOINS = " ".join(f"LEFT JOIN {q}_rows USING (unique_key)" for q in QUINTILE_COLUMNS)


@query("quintiles", with_(S.EQUITY, f"SELECT equity.unique_key, equity.zcta, {', '.join(QUINTILE_COLUMNS)} FROM equity {QUINTILE_JOINS}"))
def quintiles(spark, sf):
    frame, _ = _frame(spark, sf)
    return equity.request_quintiles(frame).select("unique_key", "zcta", *QUINTILE_COLUMNS)


TEXT_KEYS = S.EQUITY + f""", named AS (SELECT 'R-' || unique_key AS request, zcta, row_number() OVER (
    ORDER BY median_household_income, zcta, substr(md5('R-' || unique_key), 1, 15), unique_key) AS rank, count(*) OVER () AS ranked,
    (SELECT count(DISTINCT median_household_income) FROM equity) AS distinct_values FROM equity WHERE median_household_income IS NOT NULL)"""


@query("text_key_quintiles", with_(TEXT_KEYS, f"""SELECT 'R-' || unique_key AS request, equity.zcta, {S.bucket_label('rank', 'income')} AS income_quintile
    FROM equity LEFT JOIN named ON request = 'R-' || unique_key"""))
def text_key_quintiles(spark, sf):
    """Keys that are no numbers: areas on a boundary are split in the order of the keys' digests."""
    frame = _frame(spark, sf)[0].withColumn("request", F.concat(F.lit("R-"), "unique_key"))
    return equity.request_quintiles(frame, {"income_quintile": ("median_household_income", "income")}, key="request").select("request", "zcta", "income_quintile")


@query("area_quintiles", with_(S.EQUITY, f"SELECT zcta, {', '.join(QUINTILE_COLUMNS)} FROM attributes WHERE income_quintile IS NOT NULL"))
def area_quintiles(spark, sf):
    frame, _ = _frame(spark, sf)
    return equity.area_quintiles(frame)


AREA_SQL = f"""SELECT s.* EXCLUDE (borough_count), s.borough_count, {ATTR},
  CASE WHEN a.population > 0 THEN s.complaints / a.population * 10000 END AS complaints_per_10k,
  CASE WHEN a.population > 0 THEN s.unresolved_complaints / a.population * 10000 END AS unresolved_per_10k
FROM ({S.scorecard('matched', ['zcta'], {'top_borough': 'borough', 'top_agency': 'agency', 'top_complaint_type': 'complaint_type', 'top_issue_family': 'issue_family'},
                   S.EQ, ', count(DISTINCT borough) AS borough_count', subtype=False)}) s LEFT JOIN attributes a USING (zcta)"""
AREA_CTE = S.EQUITY + f", area_table AS ({AREA_SQL})"


@query("area_equity", with_(AREA_CTE, "SELECT * FROM area_table"))
def area_equity(spark, sf):
    return rounded(equity.area_equity(*_frame(spark, sf)), *DAYS)


LEVELS = S.LEVELS.replace("{source}", "matched")
GAP_SQL = S.benchmark("levels", ["issue_level", "zcta", "issue_value", "agency"], ["issue_level", "issue_value", "agency"],
                      S.EQ, "benchmark", "cell_volume_share_of_benchmark")
GAP_CTE = S.EQUITY + "," + LEVELS + f", gaps AS (SELECT g.*, {ATTR} FROM ({GAP_SQL}) g LEFT JOIN attributes a USING (zcta))"


def _gaps(spark, sf):
    return rounded(equity.matched_gaps(*_frame(spark, sf)), *DAYS, "benchmark_median_resolution_days",
                   "benchmark_p90_resolution_days", *GAPS)


@query("matched_gaps", with_(GAP_CTE, "SELECT * FROM gaps"))
def matched_gaps(spark, sf):
    return _gaps(spark, sf)


@query("worst_matched_gaps", with_(GAP_CTE, """SELECT zcta, issue_value, agency, complaints, median_resolution_gap_days, income_quintile FROM gaps
    WHERE issue_level = 'complaint_type' AND complaints >= 5 AND median_resolution_gap_days > 0
    ORDER BY median_resolution_gap_days DESC, complaints DESC, zcta, issue_value, agency LIMIT 12"""))
def worst_matched_gaps(spark, sf):
    top = ranking.slower_cells(_gaps(spark, sf), "complaint_type", 5, 12, ["zcta", "issue_value", "agency"])
    return top.select("zcta", "issue_value", "agency", "complaints", "median_resolution_gap_days", "income_quintile")


@query("poverty_gap_summary", with_(GAP_CTE, """SELECT poverty_quintile, count(*) AS cells, round(quantile_cont(median_resolution_gap_days, 0.5), 5) AS median_gap_days,
    round(quantile_cont(unresolved_share_gap, 0.5), 5) AS median_unresolved_gap FROM gaps WHERE issue_level = 'complaint_type' AND complaints >= 3 GROUP BY 1"""))
def poverty_gap_summary(spark, sf):
    return rounded(equity.poverty_gap_summary(_gaps(spark, sf), 3), "median_gap_days", "median_unresolved_gap", digits=5)


MONTH_SQL = f"""SELECT m.*, {ATTR}, CASE WHEN a.population > 0 THEN m.complaints / a.population * 10000 END AS complaints_per_10k
  FROM ({S.summary('matched', ['created_month_start', 'created_year', 'zcta'], S.EQ)}) m LEFT JOIN attributes a USING (zcta)"""
MONTH_CTE = S.EQUITY + f", monthly AS ({MONTH_SQL})"


def _monthly(spark, sf):
    return rounded(equity.equity_monthly(*_frame(spark, sf)), *DAYS)


@query("equity_monthly", with_(MONTH_CTE, "SELECT * FROM monthly"))
def equity_monthly(spark, sf):
    return _monthly(spark, sf)


@query("board_sensitivity", with_(S.EQUITY, S.scorecard(
    "equity", ["community_board", "community_board_borough", "community_board_code"],
    {"top_agency": "agency", "top_complaint_type": "complaint_type", "top_issue_family": "issue_family"}, S.EQ, subtype=False).replace(
        "FROM equity", "FROM (SELECT * REPLACE (coalesce(community_board_borough, 'Unknown') AS community_board_borough) FROM equity)")))
def board_sensitivity(spark, sf):
    frame, _ = _frame(spark, sf)
    return rounded(equity.board_sensitivity(frame), *DAYS)


@query("quintile_rollup", with_(AREA_CTE, """SELECT income_quintile AS quintile_value, count(*) AS zctas, CAST(sum(complaints) AS BIGINT) AS complaints,
    round(quantile_cont(complaints_per_10k, 0.5), 6) AS median_complaints_per_10k, round(quantile_cont(median_resolution_days, 0.5), 5) AS median_resolution_days,
    round(quantile_cont(unresolved_share, 0.5), 6) AS median_unresolved_share, round(quantile_cont(status_backlog_share, 0.5), 6) AS median_status_backlog_share
    FROM area_table GROUP BY 1"""))
def quintile_rollup(spark, sf):
    rolled = equity.quintile_rollup(area_equity(spark, sf), "income_quintile")
    return rounded(rounded(rolled, "median_resolution_days", digits=5), "median_complaints_per_10k", "median_unresolved_share", "median_status_backlog_share")


@query("quintile_monthly", with_(MONTH_CTE, " UNION ALL ".join(f"""SELECT strftime(created_month_start, '%Y-%m') AS month_label, '{q}' AS quintile_label, {q} AS quintile_value,
    CAST(sum(complaints) AS BIGINT) AS complaints, round(quantile_cont(median_resolution_days, 0.5), 5) AS median_resolution_days,
    round(quantile_cont(unresolved_share, 0.5), 6) AS unresolved_share, round(quantile_cont(status_backlog_share, 0.5), 6) AS status_backlog_share
    FROM monthly WHERE {q} IS NOT NULL GROUP BY 1, 2, 3""" for q in QUINTILE_COLUMNS)))
def quintile_monthly(spark, sf):
    rolled = equity.quintile_monthly(with_month_label(_monthly(spark, sf)))
    return rounded(rounded(rolled, "median_resolution_days", digits=5), "unresolved_share", "status_backlog_share")


@query("poverty_monthly", with_(MONTH_CTE, """SELECT created_month_start, created_year, poverty_quintile, CAST(sum(complaints) AS BIGINT) AS complaints,
    CAST(sum(unresolved_complaints) AS BIGINT) AS unresolved_complaints, CAST(sum(unresolved_complaints) AS DOUBLE) / CAST(sum(complaints) AS DOUBLE) AS unresolved_share
    FROM monthly WHERE poverty_quintile IN ('Q1 lowest poverty', 'Q5 highest poverty') GROUP BY 1, 2, 3"""))
def poverty_monthly(spark, sf):
    return equity.poverty_monthly(_monthly(spark, sf))


@query("minmax_scale", with_(AREA_CTE + ", b AS (SELECT min(complaints) AS lo, max(complaints) AS hi FROM area_table)",
                             "SELECT zcta, round(40 + (complaints - lo) / CAST(hi - lo AS DOUBLE) * 360, 6) AS marker FROM area_table, b"))
def minmax_scale(spark, sf):
    frame, _ = _frame(spark, sf)
    counts = ranking.count_by(filters.matched_areas(frame), "zcta")
    return rounded(ranking.minmax_scale(counts, "complaints", "marker", 40, 400).select("zcta", "marker"), "marker")


@query("matched_areas", with_(S.EQUITY, "SELECT unique_key, zcta FROM matched"))
def matched_areas(spark, sf):
    frame, _ = _frame(spark, sf)
    return filters.matched_areas(frame).select("unique_key", "zcta")


@query("equity_models")
def equity_models(spark, sf):
    frame, _ = _frame(spark, sf)
    return rounded(equity.adjusted_models(frame), "coefficient", "metric_value")


# The duration model's normal equations: rows and summed log days of every pair of feature levels.
FEATURES = [*QUINTILE_COLUMNS, *equity.CONTROL_FEATURES]
_FIRST = ", ".join(f"min(CAST({f} AS VARCHAR)) AS first_{f}" for f in FEATURES)
_TERMS = ", ".join(f"CASE WHEN CAST({f} AS VARCHAR) <> first_{f} THEN '{f}=' || CAST({f} AS VARCHAR) END" for f in FEATURES)
_KNOWN = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
NORMAL_EQUATIONS = with_(S.EQUITY + f""", labelled_rows AS (SELECT m.unique_key, m.resolution_days, {', '.join(f'm.{f}' for f in equity.CONTROL_FEATURES)}, {', '.join(QUINTILE_COLUMNS)}
    FROM matched m {QUINTILE_JOINS} WHERE m.resolved_with_valid_date AND m.resolution_days IS NOT NULL),
model_rows AS (SELECT * FROM labelled_rows WHERE {_KNOWN}),
firsts AS (SELECT {_FIRST} FROM model_rows),
termed AS (SELECT ln(1 + resolution_days) AS y, list_filter(['(intercept)', {_TERMS}], lambda t: t IS NOT NULL) AS terms FROM model_rows, firsts),
lefts AS (SELECT y, terms, unnest(terms) AS left_term FROM termed), pairs AS (SELECT y, left_term, unnest(terms) AS right_term FROM lefts)""",
    """SELECT left_term, right_term, count(*) AS rows, round(CASE WHEN left_term = '(intercept)' OR right_term = '(intercept)' THEN sum(y) END, 6) AS total
    FROM pairs WHERE left_term <= right_term GROUP BY 1, 2""")


@query("equity_normal_equations", NORMAL_EQUATIONS)
def equity_normal_equations(spark, sf):
    frame, _ = _frame(spark, sf)
    rows = equity.model_rows(frame, cut_lineage(equity.quintile_table(frame)))
    return rounded(collapsed.normal_equations(equity.duration_design(rows), "total"), "total")


@query("ranked_coefficients")
def ranked_coefficients(spark, sf):
    frame, _ = _frame(spark, sf)
    return rounded(equity.ranked_coefficients(equity.adjusted_models(frame), "log_resolution_days", 8), "coefficient", "abs_coefficient")


# Reference tables ----------------------------------------------------------------

# A census extract per area: counts as text, some missing, zip codes without leading zeros.
CENSUS_SQL = """SELECT CAST(c_custkey % 200 + 900 AS {text}) AS "{area}", 'area ' || CAST(c_custkey % 200 AS {text}) AS "NAME",
  CAST(count(*) * 100 AS {text}) AS "B01003_001E", """ + ", ".join(
    f"CASE WHEN c_custkey % 200 % {7 + i} = 0 THEN {'NULL' if i % 2 else chr(39) + 'n/a' + chr(39)} ELSE CAST((c_custkey % 200) * {i + 3} % 97 AS {{text}}) END AS \"{code}\""
    for i, code in enumerate(CENSUS_VARIABLES.values())) + " FROM {customer} GROUP BY c_custkey % 200"


def _census(spark, sf):
    sql = CENSUS_SQL.replace("{text}", "STRING").replace("{area}", areas.AREA_COLUMN).replace('"', "`")
    return spark.sql(sql, customer=V.table(spark, sf, "customer"))


def _number(name: str) -> str:
    return f"TRY_CAST(\"{CENSUS_VARIABLES[name]}\" AS DOUBLE)"


_DIRECT = [n for n in CENSUS_VARIABLES if not n.endswith("_degree")]
_DEGREES = [_number(n) for n in CENSUS_VARIABLES if n.endswith("_degree")]


def _ratio(top: str, bottom: str, name: str) -> str:
    return f"CASE WHEN {bottom} <> 0 THEN {top} / {bottom} END AS {name}"


CENSUS = f"""census AS ({CENSUS_SQL.replace('{text}', 'VARCHAR').replace('{area}', 'area').replace('{customer}', 'customer')}),
named AS (SELECT lpad(area, 5, '0') AS zcta, "NAME" AS acs_name, CAST("B01003_001E" AS DOUBLE) AS population, {', '.join(f'{_number(n)} AS {n}' for n in _DIRECT)},
  CASE WHEN coalesce({', '.join(_DEGREES)}) IS NOT NULL THEN {' + '.join(f'coalesce({d}, 0)' for d in _DEGREES)} END AS bachelors_or_higher_count FROM census),
shares AS (SELECT * EXCLUDE (population), {_ratio('poverty_count', 'poverty_universe', 'poverty_share')}, {_ratio('renter_occupied_units', 'occupied_housing_units', 'renter_share')},
  {_ratio('(race_ethnicity_total - non_hispanic_white_alone)', 'race_ethnicity_total', 'nonwhite_share')},
  {_ratio('bachelors_or_higher_count', 'education_total_25_plus', 'bachelors_or_higher_share')} FROM named)"""


@query("demographic_shares", with_(CENSUS, "SELECT * FROM shares"))
def demographic_shares(spark, sf):
    return areas.demographic_columns(_census(spark, sf))


REFERENCE = S.ANALYTIC + "," + CENSUS + """,
seen AS (SELECT DISTINCT nullif(regexp_extract(incident_zip, '[0-9]{5}'), '') AS zcta FROM analytic WHERE borough IN ('ASIA', 'EUROPE', 'AFRICA')),
base AS (SELECT DISTINCT CAST(10000 + c_custkey % 220 AS VARCHAR) AS zcta FROM customer),
population AS (SELECT lpad(CAST(CAST(area AS INT) + 9100 AS VARCHAR), 5, '0') AS zcta, "NAME" AS zcta_name, CAST("B01003_001E" AS DOUBLE) AS population FROM census WHERE CAST(area AS INT) % 3 <> 0)"""


def _reference(spark, sf):
    base = V.table(spark, sf, "customer").select((10000 + F.col("c_custkey") % 220).cast("string").alias("zcta")).distinct()
    census = _census(spark, sf).withColumn("n", F.col(f"`{areas.AREA_COLUMN}`").cast("int")).where("n % 3 <> 0")
    shifted = census.withColumn(areas.AREA_COLUMN, (F.col("n") + 9100).cast("string")).drop("n")
    return areas.build_area_reference(base, V.analytic(spark, sf), areas.population_table(shifted), ["ASIA", "EUROPE", "AFRICA"])


REFERENCE_SQL = """SELECT base.zcta, population.zcta_name, population.population, population.population IS NULL AS population_missing_flag
    FROM base LEFT JOIN population ON base.zcta = population.zcta WHERE base.zcta IN (SELECT zcta FROM seen WHERE zcta IS NOT NULL)"""


@query("area_reference", with_(REFERENCE, REFERENCE_SQL))
def area_reference(spark, sf):
    reference = _reference(spark, sf)
    return reference.select(*[f.name for f in AREA_REFERENCE_SCHEMA if f.name in reference.columns])


@query("area_demographics", with_(REFERENCE + f""", reference AS ({REFERENCE_SQL}), shifted AS (SELECT * REPLACE (CAST(CAST(zcta AS INT) + 9100 AS VARCHAR) AS zcta) FROM shares)""",
    """SELECT r.zcta, r.zcta_name, r.population, s.* EXCLUDE (zcta), s.median_household_income IS NULL AS acs_missing_flag, r.population IS NULL AS population_gap_flag
    FROM reference r LEFT JOIN shifted s ON r.zcta = s.zcta"""))
def area_demographics(spark, sf):
    shares = areas.demographic_columns(_census(spark, sf)).withColumn("zcta", (F.col("zcta").cast("int") + 9100).cast("string"))
    return areas.build_area_demographics(_reference(spark, sf), shares)
