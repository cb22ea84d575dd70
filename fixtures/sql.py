"""Building blocks of the SQL oracles: the fixture views as common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from fixtures.views import AREA_SQL, CLOSURE_PHRASES, MISMATCHES, RULES, SCOPE
from reqlens.rules import MISDECODED_SEQUENCES, OUTCOME_RULES

BASE, PARTIAL = SCOPE.base_year, SCOPE.partial_year


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(column: str, *extra: str) -> str:
    tokens = ", ".join(quote(t) for t in ("", "nan", "None", "NULL", "NaN", *extra))
    return f"CASE WHEN trim({column}) NOT IN ({tokens}) THEN trim({column}) END"


def normalize(column: str) -> str:
    text = f"coalesce({clean(column)}, '')"
    for bad, good in MISDECODED_SEQUENCES.items():
        text = f"replace({text}, {quote(bad)}, {quote(good)})"
    return f"nullif(trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9/&+ -]+', ' ', 'g'), ' +', ' ', 'g')), '')"


def matches(columns: Sequence[str], pattern: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(coalesce({c}, ''), {quote(pattern)})" for c in columns) + ")"


def closure_case() -> str:
    whens = " ".join(f"WHEN {i} THEN {quote(p)}" for i, p in enumerate(CLOSURE_PHRASES))
    return f"CASE o_orderkey % {len(CLOSURE_PHRASES) + 1} {whens} END"


RAW = f"""
shipped AS (
  SELECT l_orderkey, max(l_shipdate) AS shipped, min(p_name) AS p_name, min(p_type) AS p_type
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
raw AS (
  SELECT o_orderkey, c_custkey, n_nationkey, r_name,
    CAST(o_orderkey AS VARCHAR) AS unique_key,
    o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER)) AS created_date,
    shipped + to_minutes(CAST(o_orderkey * 53 % 1440 AS INTEGER)) AS closed_date,
    CASE WHEN c_custkey % 37 = 0 THEN ' ' ELSE lower(c_mktsegment) END AS agency,
    CASE WHEN c_custkey % 37 = 0 THEN 'NaN' ELSE c_mktsegment || ' desk ' END AS agency_name,
    CASE WHEN o_orderkey % 41 = 0 THEN 'NULL' ELSE o_orderpriority END AS complaint_type,
    p_name AS descriptor,
    CASE WHEN o_orderkey % 11 = 0 THEN ' None ' ELSE p_type END AS additional_details,
    CASE WHEN c_custkey % 17 = 0 THEN NULL
         WHEN c_custkey % 13 = 0 THEN 'area ' || CAST(10000 + c_custkey % 200 AS VARCHAR) || '-12'
         ELSE CAST(10000 + c_custkey % 200 AS VARCHAR) END AS incident_zip,
    CASE WHEN c_custkey % 31 = 0 THEN 'Unspecified' WHEN o_orderstatus = 'F' THEN ' closed '
         WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'in-progress' END AS status,
    CASE WHEN n_nationkey = 7 THEN NULL
         ELSE lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ' ' || r_name END AS community_board,
    CASE WHEN c_custkey % 43 = 0 THEN 'n/a' ELSE CAST(c_custkey % 51 AS VARCHAR) END AS council_district,
    CASE WHEN c_custkey % 19 = 0 THEN 'Unspecified' ELSE lower(r_name) END AS borough,
    CASE WHEN c_custkey % 23 = 0 THEN NULL
         ELSE CAST(40.49 + (c_custkey % 44) * 0.01 + 0.005 + CASE WHEN c_custkey % 29 = 0 THEN 5 ELSE 0 END AS DOUBLE) END AS latitude,
    CAST(-74.28 + (c_custkey % 60) * 0.01 + 0.005 AS DOUBLE) AS longitude,
    {closure_case()} AS resolution_description
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN shipped ON l_orderkey = o_orderkey
)"""

ANALYTIC = RAW + f""",
cleaned AS (
  SELECT unique_key, o_orderkey, created_date, closed_date,
    coalesce(upper({clean('agency')}), 'UNKNOWN') AS agency,
    coalesce({clean('agency_name')}, 'Unknown Agency') AS agency_name,
    coalesce({clean('complaint_type')}, 'Unknown') AS complaint_type,
    coalesce({clean('descriptor')}, 'Unknown') AS descriptor,
    {clean('additional_details')} AS additional_details,
    incident_zip, community_board,
    CASE {clean('status', 'Unspecified')} WHEN 'closed' THEN 'Closed' WHEN 'OPEN' THEN 'Open'
      WHEN 'in-progress' THEN 'In-Progress' ELSE 'Unknown' END AS status,
    TRY_CAST(council_district AS BIGINT) AS council_district,
    upper({clean('borough', 'Unspecified')}) AS borough,
    latitude, longitude, resolution_description,
    (epoch_us(closed_date) - epoch_us(created_date)) / 1e6 / 3600.0 AS hours
  FROM raw WHERE created_date >= TIMESTAMP '{SCOPE.start}'
),
analytic AS (
  SELECT *,
    CAST(year(created_date) AS INTEGER) AS created_year, CAST(month(created_date) AS INTEGER) AS created_month,
    CAST(date_trunc('month', created_date) AS TIMESTAMP) AS created_month_start,
    dayname(created_date) AS created_weekday, CAST(hour(created_date) AS INTEGER) AS created_hour,
    CASE WHEN month(created_date) IN (12, 1, 2) THEN 'Winter' WHEN month(created_date) <= 5 THEN 'Spring'
         WHEN month(created_date) <= 8 THEN 'Summer' ELSE 'Fall' END AS created_season,
    status = 'Closed' AS is_closed_status, closed_date IS NOT NULL AS has_closed_date,
    latitude IS NULL OR longitude IS NULL AS missing_coordinates_flag, borough IS NULL AS missing_borough_flag,
    status = 'Closed' AND closed_date IS NULL AS closed_status_missing_date_flag,
    status <> 'Closed' AND closed_date IS NOT NULL AS nonclosed_status_has_date_flag,
    coalesce(hours < 0, false) AS negative_resolution_flag,
    CASE WHEN hours >= 0 THEN hours END AS resolution_hours,
    CASE WHEN hours >= 0 THEN hours / 24.0 END AS resolution_days,
    coalesce(hours >= 0, false) AS resolved_with_valid_date,
    CASE WHEN hours < 0 THEN NULL WHEN hours / 24.0 <= 1 THEN '<1 day' WHEN hours / 24.0 <= 3 THEN '1-3 days'
         WHEN hours / 24.0 <= 7 THEN '3-7 days' WHEN hours / 24.0 <= 30 THEN '7-30 days'
         WHEN hours IS NOT NULL THEN '30+ days' END AS resolution_bucket
  FROM cleaned
)"""


def rule_case(rules, value) -> str:
    parts = []
    for family, family_rules in rules.items():
        whens = " ".join(f"WHEN {matches(r.columns, r.pattern)} THEN {value(r)}" for r in family_rules)
        parts.append(f"WHEN complaint_type = {quote(family)} THEN CASE {whens} END")
    return "CASE " + " ".join(parts) + " END"


def _quoted_text(rule) -> str:
    return {"descriptor_norm": "descriptor", "details_norm": "additional_details"}.get(rule.match_column, "combined_text")


def mismatch_case(rules, value) -> str:
    # Later rules overwrite earlier ones.
    whens = " ".join(
        f"WHEN complaint_type = {quote(r.complaint_type)} AND {matches(r.columns, r.pattern)} THEN {value(r)}"
        for r in reversed(rules))
    return f"CASE WHEN issue_subtype <> 'other_unclassified' THEN NULL {whens} END"


def subtype_ctes(source: str, rules, mismatches) -> str:
    families = ", ".join(quote(f) for f in rules)
    modeled = f"complaint_type IN ({families})"
    return f"""
normed AS (
  SELECT *, {normalize('descriptor')} AS descriptor_norm, {normalize('additional_details')} AS details_norm FROM {source}
),
combined AS (
  SELECT *, trim(coalesce(descriptor_norm, '') || ' | ' || coalesce(details_norm, ''), ' |') AS combined_text FROM normed
),
subtyped AS (
  SELECT *, nullif(combined_text, '') AS text_clean, complaint_type AS issue_family, {modeled} AS subtype_modeled_flag,
    CASE WHEN {modeled} THEN coalesce({rule_case(rules, lambda r: quote(r.subtype))}, 'other_unclassified') ELSE 'not_modeled' END AS issue_subtype,
    CASE WHEN {modeled} THEN coalesce({rule_case(rules, lambda r: quote(r.confidence))}, 'low') ELSE 'not_modeled' END AS issue_subtype_confidence,
    CASE WHEN {modeled} THEN coalesce({rule_case(rules, lambda r: quote(r.source))}, 'unmatched') ELSE 'not_modeled' END AS subtype_source,
    {rule_case(rules, _quoted_text)} AS subtype_match_text
  FROM combined
),
flagged AS (
  SELECT *, {mismatch_case(mismatches, lambda r: 'true')} IS NOT NULL AS potential_label_mismatch_flag,
    {mismatch_case(mismatches, lambda r: quote(r.suspected_family))} AS mismatch_suspected_family,
    {mismatch_case(mismatches, lambda r: 'coalesce(descriptor, additional_details)')} AS mismatch_match_text
  FROM subtyped
)"""


def outcome_case(value, other: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(closure_norm, {quote(r.pattern)}) THEN {quote(value(r))}" for r in OUTCOME_RULES)
    return f"CASE WHEN closure_norm IS NULL THEN NULL {whens} ELSE {quote(other)} END"


LABELLED = ANALYTIC + "," + subtype_ctes("analytic", RULES, MISMATCHES) + f""",
closing AS (
  SELECT *, CASE WHEN subtype_modeled_flag AND trim(resolution_description) <> ''
    THEN coalesce({normalize('resolution_description')}, '') END AS closure_norm
  FROM flagged
),
labelled AS (
  SELECT *, closure_norm IS NOT NULL AS resolution_has_text,
    coalesce({outcome_case(lambda r: r.outcome, 'other_resolution_language')}, 'no_resolution_text') AS resolution_outcome_group,
    coalesce({outcome_case(lambda r: r.confidence, 'low')}, 'not_applicable') AS resolution_outcome_confidence,
    CAST(length(closure_norm) AS BIGINT) AS resolution_text_length
  FROM closing
)"""

ENRICHED = LABELLED + """,
enriched AS (
  SELECT *, NOT resolved_with_valid_date AS unresolved_flag, NOT is_closed_status AS status_backlog_flag,
    nullif(regexp_extract(incident_zip, '[0-9]{5}'), '') AS incident_zip_clean,
    coalesce(latitude BETWEEN 40.49e0 AND 40.93e0 AND longitude BETWEEN -74.28e0 AND -73.68e0, false) AS valid_coordinate_flag,
    nullif(regexp_extract(community_board, '^([0-9]{2})', 1), '') AS community_board_code,
    coalesce(nullif(regexp_extract(community_board, '([A-Z][A-Z ]+)$', 1), ''), borough) AS community_board_borough
  FROM labelled
)"""

AREAS = "areas AS (" + AREA_SQL.replace("{text}", "VARCHAR").replace("{customer}", "customer") + ")"

QUINTILE_SOURCES = {
    "income_quintile": ("median_household_income", "income"), "poverty_quintile": ("poverty_share", "poverty"),
    "renter_quintile": ("renter_share", "renter"), "nonwhite_quintile": ("nonwhite_share", "nonwhite"),
    "education_quintile": ("bachelors_or_higher_share", "education"),
}


def bucket_label(rank: str, word: str) -> str:
    number = f"greatest(1, CAST(ceil(({rank} - 1) * 5.0 / (ranked - 1)) AS INTEGER))"
    return (f"CASE WHEN {rank} IS NULL OR distinct_values < 5 THEN NULL ELSE CASE {number} WHEN 1 THEN 'Q1 lowest {word}' WHEN 2 THEN 'Q2' "
            f"WHEN 3 THEN 'Q3' WHEN 4 THEN 'Q4' ELSE 'Q5 highest {word}' END END")


def _ranked_ctes() -> str:
    parts = []
    for name, (source, word) in QUINTILE_SOURCES.items():
        parts.append(f"""
{name}_ranks AS (
  SELECT unique_key, zcta, row_number() OVER (ORDER BY {source}, zcta, o_orderkey) AS rank,
    count(*) OVER () AS ranked, (SELECT count(DISTINCT {source}) FROM equity) AS distinct_values
  FROM equity WHERE {source} IS NOT NULL
),
{name}_rows AS (SELECT unique_key, {bucket_label('rank', word)} AS {name} FROM {name}_ranks),
{name}_areas AS (
  SELECT zcta, {bucket_label('first_rank', word)} AS {name}
  FROM (SELECT zcta, min(rank) AS first_rank, max(ranked) AS ranked, max(distinct_values) AS distinct_values FROM {name}_ranks GROUP BY zcta)
)""")
    joins = " ".join(f"LEFT JOIN {name}_areas USING (zcta)" for name in QUINTILE_SOURCES)
    parts.append(f"""
attributes AS (
  SELECT zcta, population, median_household_income, poverty_share, renter_share, nonwhite_share,
    bachelors_or_higher_share, median_gross_rent, acs_missing_flag, {', '.join(QUINTILE_SOURCES)}
  FROM areas {joins}
)""")
    return ",".join(parts)


EQUITY = ENRICHED + "," + AREAS + """,
equity AS (
  SELECT enriched.* EXCLUDE (borough), coalesce(borough, 'Unknown') AS borough, incident_zip_clean AS zcta,
    areas.* EXCLUDE (zcta, zcta_name), median_household_income IS NOT NULL AS zcta_demographic_match_flag
  FROM enriched LEFT JOIN areas ON incident_zip_clean = zcta
),
matched AS (SELECT * FROM equity WHERE zcta IS NOT NULL AND zcta_demographic_match_flag),""" + _ranked_ctes()

OPS = {
    "resolved_complaints": ("resolved_with_valid_date", "resolved_share"),
    "unresolved_complaints": ("unresolved_flag", "unresolved_share"),
    "status_backlog_complaints": ("status_backlog_flag", "status_backlog_share"),
    "closed_status_missing_date_count": ("closed_status_missing_date_flag", "closed_status_missing_date_share"),
    "nonclosed_status_has_date_count": ("nonclosed_status_has_date_flag", "nonclosed_status_has_date_share"),
    "negative_resolution_count": ("negative_resolution_flag", "negative_resolution_share"),
    "mismatch_flagged_complaints": ("potential_label_mismatch_flag", "mismatch_flag_share"),
}
EQ = {k: OPS[k] for k in ("resolved_complaints", "unresolved_complaints", "status_backlog_complaints", "mismatch_flagged_complaints")}


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def summary(source: str, keys: Sequence[str], counts=OPS, extra: str = "") -> str:
    head = "".join(f"{k}, " for k in keys)
    flags = ", ".join(f"count(*) FILTER (WHERE {flag}) AS {name}" for name, (flag, _) in counts.items())
    shares = ", ".join(f"count(*) FILTER (WHERE {flag}) / CAST(count(*) AS DOUBLE) AS {share}" for flag, share in counts.values())
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return (f"SELECT {head}count(*) AS complaints, {flags}, {shares}, "
            f"round(quantile_cont(resolution_days, 0.5) FILTER (WHERE resolved_with_valid_date), 6) AS median_resolution_days, "
            f"round(quantile_cont(resolution_days, 0.9) FILTER (WHERE resolved_with_valid_date), 6) AS p90_resolution_days{extra} "
            f"FROM {source}{group}")


def mode_table(source: str, keys: Sequence[str], column: str, alias: str, where: str = "true") -> str:
    k = ", ".join(keys)
    return (f"(SELECT {k}, {column} AS {alias} FROM (SELECT {k}, {column}, row_number() OVER (PARTITION BY {k} "
            f"ORDER BY count(*) DESC, {column}) AS rn FROM {source} WHERE {column} IS NOT NULL AND {where} "
            f"GROUP BY {k}, {column}) WHERE rn = 1)")


def same(left: str, right: str, keys: Sequence[str]) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)


def scorecard(source: str, keys: Sequence[str], modes: dict[str, str], counts=OPS, extra: str = "",
              subtype: bool = True, more: str = "") -> str:
    """Summary plus label modes; ``extra`` goes into the grouped select, ``more`` into the outer one."""
    joins, columns = [], []
    for i, (alias, column) in enumerate(modes.items()):
        joins.append(f"LEFT JOIN {mode_table(source, keys, column, alias)} m{i} ON {same('s', f'm{i}', keys)}")
        columns.append(f"coalesce(m{i}.{alias}, 'Unknown') AS {alias}")
    if subtype:
        table = mode_table(source, keys, "issue_subtype", "top_modeled_subtype", "subtype_modeled_flag AND issue_subtype <> 'not_modeled'")
        joins.append(f"LEFT JOIN {table} t ON {same('s', 't', keys)}")
        columns.append("t.top_modeled_subtype")
    return f"SELECT s.*, {', '.join(columns)}{more} FROM ({summary(source, keys, counts, extra)}) s {' '.join(joins)}"


LEVELS = """levels AS (
  SELECT *, 'complaint_type' AS issue_level, complaint_type AS issue_value FROM {source}
  UNION ALL SELECT *, 'issue_family', issue_family FROM {source}
  UNION ALL SELECT *, 'issue_subtype', issue_subtype FROM {source} WHERE subtype_modeled_flag AND issue_subtype <> 'not_modeled'
)"""


def raw_quantiles(sql: str) -> str:
    """Unrounded quantiles, where a difference is rounded afterwards."""
    return sql.replace("round(quantile_cont", "(quantile_cont").replace("resolved_with_valid_date), 6)", "resolved_with_valid_date))")


def benchmark(source: str, cell_keys, bench_keys, counts, prefix: str, share: str) -> str:
    compared = ["complaints", "resolved_complaints", "unresolved_complaints", "status_backlog_complaints",
                "resolved_share", "unresolved_share", "status_backlog_share"]
    fixed = ", ".join(f"b.{c} AS {prefix}_{c}" for c in compared)
    return f"""
SELECT c.* REPLACE (round(c.median_resolution_days, 6) AS median_resolution_days, round(c.p90_resolution_days, 6) AS p90_resolution_days),
  {fixed}, round(b.median_resolution_days, 6) AS {prefix}_median_resolution_days, round(b.p90_resolution_days, 6) AS {prefix}_p90_resolution_days,
  c.complaints / CAST(b.complaints AS DOUBLE) AS {share},
  round(c.median_resolution_days - b.median_resolution_days, 6) AS median_resolution_gap_days,
  round(c.p90_resolution_days - b.p90_resolution_days, 6) AS p90_resolution_gap_days,
  round(c.unresolved_share - b.unresolved_share, 6) AS unresolved_share_gap,
  round(c.status_backlog_share - b.status_backlog_share, 6) AS status_backlog_share_gap
FROM ({raw_quantiles(summary(source, cell_keys, counts))}) c
JOIN ({raw_quantiles(summary(source, bench_keys, counts))}) b ON {same('c', 'b', bench_keys)}"""
