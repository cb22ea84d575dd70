"""Request, area and demographic views derived from the driver tables.

The tables hold orders, so an order plays the part of a service request. Raw values are made
untidy on purpose (blanks, null words, unknown places) so that the cleaning has work to do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqlens.contracts import Scope
from reqlens.operators import frames, taxonomy
from reqlens.rules import MismatchRule, SubtypeRule
from reqlens.session import cut_lineage, prepare

SCOPE = Scope(start="1996-01-01", base_year=2000, partial_year=2001)
GRID = 0.1

D, A, C = ("descriptor_norm",), ("details_norm",), ("combined_text",)
# Our own small taxonomy over part names and types.
RULES = {
    "1-URGENT": [
        SubtypeRule("old_stock", "^old |old bolt", D, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("promo_item", "promo", A, "high", "additional_details_rule", "details_norm"),
        SubtypeRule("blue_item", "blue|bolt", D + C, "medium", "combined_text_rule", "descriptor_norm"),
    ],
    "2-HIGH": [
        SubtypeRule("moving_part", "gear|rod$", D, "high", "descriptor_rule", "descriptor_norm"),
        SubtypeRule("cold_economy", r"cold .* \| economy", C, "medium", "combined_text_rule", "combined_text"),
    ],
    "3-MEDIUM": [
        SubtypeRule("anvil", "anvil", D + A + C, "high", "descriptor_or_detail_rule", "descriptor_norm"),
        SubtypeRule("large_detail", "^large$|standard", A, "high", "additional_details_rule", "details_norm"),
    ],
}
MISMATCHES = [
    MismatchRule("1-URGENT", "Supply", "economy|small", D + C),
    MismatchRule("2-HIGH", "Supply", "economy|blue", D + C),
    MismatchRule("2-HIGH", "Storage", "anvil|widget", D + A),
]
# Closure phrases, chosen by the order key; null and blank included.
CLOSURE_PHRASES = [
    "This is a duplicate of a building-wide condition.",
    "The inspector was unable to gain access, again",
    "The Police Department issued a summons!",
    "Violations were issued",
    "The condition was corrected.",
    "Officers observed no evidence of the violation",
    "It was found that police action was not necessary",
    "The owner did not violate the housing laws",
    "Please call or see our website",
    "The agency conducted an inspection",
    "The customerâ\u0080\u0099s request was noted â\u0080\u0093 thank you",
    "   ",
]

RAW_SQL = """
WITH shipped AS (
  SELECT l_orderkey, max(l_shipdate) AS shipped{text_columns}
  FROM lineitem{text_join}
  GROUP BY l_orderkey
)
SELECT
  o_orderkey AS unique_key,
  o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey * 37 % 1440 AS INT)) AS created_date,
  shipped + make_dt_interval(0, 0, CAST(o_orderkey * 53 % 1440 AS INT)) AS closed_date,
  CAST(NULL AS TIMESTAMP_NTZ) AS resolution_action_updated_date,
  CASE WHEN c_custkey % 37 = 0 THEN ' ' ELSE lower(c_mktsegment) END AS agency,
  CASE WHEN c_custkey % 37 = 0 THEN 'NaN' ELSE c_mktsegment || ' desk ' END AS agency_name,
  CASE WHEN o_orderkey % 41 = 0 THEN 'NULL' ELSE o_orderpriority END AS problem_formerly_complaint_type,
  {descriptor} AS problem_detail_formerly_descriptor,
  {details} AS additional_details,
  CASE WHEN c_custkey % 17 = 0 THEN NULL
       WHEN c_custkey % 13 = 0 THEN 'area ' || CAST(10000 + c_custkey % 200 AS STRING) || '-12'
       ELSE CAST(10000 + c_custkey % 200 AS STRING) END AS incident_zip,
  CAST(NULL AS STRING) AS city,
  CASE WHEN c_custkey % 31 = 0 THEN 'Unspecified' WHEN o_orderstatus = 'F' THEN ' closed '
       WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'in-progress' END AS status,
  CASE WHEN n_nationkey = 7 THEN NULL
       ELSE lpad(CAST(n_nationkey AS STRING), 2, '0') || ' ' || r_name END AS community_board,
  CASE WHEN c_custkey % 43 = 0 THEN 'n/a' ELSE CAST(c_custkey % 51 AS STRING) END AS council_district,
  CASE WHEN c_custkey % 19 = 0 THEN 'Unspecified' ELSE lower(r_name) END AS borough,
  CASE WHEN c_custkey % 23 = 0 THEN NULL
       ELSE CAST(CAST(40.49 + (c_custkey % 44) * 0.01 + 0.005 + CASE WHEN c_custkey % 29 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS STRING) END AS latitude,
  CAST(CAST(-74.28 + (c_custkey % 60) * 0.01 + 0.005 AS DOUBLE) AS STRING) AS longitude,
  {closure} AS resolution_description
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
LEFT JOIN shipped ON l_orderkey = o_orderkey
"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def closure_case() -> str:
    cases = " ".join(f"WHEN {i} THEN {_quote(p)}" for i, p in enumerate(CLOSURE_PHRASES))
    return f"CASE o_orderkey % {len(CLOSURE_PHRASES) + 1} {cases} END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts; spread over the cores where the files give fewer splits than there are cores."""
    texts = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores)


_VIEWS: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """One definition per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _VIEWS:
        _VIEWS[key] = build()
    return _VIEWS[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _once(spark, sf_dir, f"table {name}", lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def raw_requests(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Raw requests; part names and types are joined in only when ``text`` is asked for."""
    prepare(spark)
    names = ("orders", "customer", "nation", "region", "lineitem") + (("part",) if text else ())
    sql = RAW_SQL.format(
        text_columns=", min(p_name) AS p_name, min(p_type) AS p_type" if text else "",
        text_join=" LEFT JOIN {part} ON l_partkey = p_partkey" if text else "",
        descriptor="p_name" if text else "CAST(NULL AS STRING)",
        details="CASE WHEN o_orderkey % 11 = 0 THEN ' None ' ELSE p_type END" if text else "CAST(NULL AS STRING)",
        closure=closure_case() if text else "CAST(NULL AS STRING)")
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} ON", f"JOIN {{{name}}} ON")
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def analytic(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    return _once(spark, sf_dir, f"analytic {text}",
                 lambda: frames.build_analytic(raw_requests(spark, sf_dir, text), SCOPE))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analytic rows with every text label, added in place; evaluated by the query itself."""
    def build() -> DataFrame:
        raw = raw_requests(spark, sf_dir, text=True)
        base = frames.add_lifecycle(frames.in_scope(
            frames.clean_requests(raw.withColumn("city", F.col("resolution_description"))), SCOPE))
        return taxonomy.label_requests(base.withColumn("resolution_description", F.col("city")), RULES, MISMATCHES)
    return _once(spark, sf_dir, "labelled", build)


def enriched(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """The enriched stage table: written once per session, as between stages, then scanned.

    Queries that read few ``columns`` write and scan a table of these alone, unless the whole one was written already.
    """
    whole = (spark.sparkContext.applicationId, sf_dir, "enriched")
    if columns and whole in _VIEWS:
        return _VIEWS[whole].select(*columns)
    return _once(spark, sf_dir, " ".join(["enriched", *columns]), lambda: cut_lineage(
        frames.enrich_inline(labelled(spark, sf_dir)).select(*(columns or ["*"]))))


AREA_SQL = """
SELECT zcta, 'area ' || zcta AS zcta_name,
  CASE WHEN n % 10 = 3 THEN 0e0 ELSE 1000e0 * residents END AS population,
  CASE WHEN n % 10 = 9 THEN NULL ELSE income END AS median_household_income,
  CASE WHEN n % 10 = 9 THEN NULL ELSE (n * 7 % 101) / 101e0 END AS poverty_share,
  CASE WHEN n % 10 = 9 THEN NULL ELSE (n * 13 % 103) / 103e0 END AS renter_share,
  CASE WHEN n % 10 = 9 THEN NULL ELSE (n * 17 % 107) / 107e0 END AS nonwhite_share,
  CASE WHEN n % 10 = 9 THEN NULL ELSE (n * 29 % 7) / 7e0 END AS bachelors_or_higher_share,
  CASE WHEN n % 10 = 9 THEN NULL ELSE 900e0 + n END AS median_gross_rent,
  n % 10 = 9 AS acs_missing_flag
FROM (
  SELECT c_custkey % 200 AS n, CAST(10000 + c_custkey % 200 AS {text}) AS zcta,
         count(*) AS residents,
         CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS income
  FROM {customer} GROUP BY c_custkey % 200
)
"""


def area_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per area: every tenth without demographics, some with population zero. Written once, as every scan of requests joins it."""
    sql = AREA_SQL.replace("{text}", "STRING")
    return _once(spark, sf_dir, "areas", lambda: cut_lineage(spark.sql(sql, customer=table(spark, sf_dir, "customer"))))
