"""Ingest, sinks, sorts and selections over tables that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from fixtures import sql as S
from fixtures import views as V
from fixtures.forecasts import FRAME, PREDICTED, _frame as model_rows, _predictions, _report_sql, _with_train_rows
from fixtures.geography import BOARD_METRICS_SQL, GRID, _located
from fixtures.registry import query, rounded
from fixtures.sql import BASE, with_
from reqlens.contracts import BUCKET_ORDER
from reqlens.operators import forecast, frames, geography, summaries
from reqlens.plans.stages import sort_table
from reqlens.session import prepare, shared_folder
from reqlens.sources import bucketed, raw, tables


def _folder(spark, name: str) -> str:
    return f"{shared_folder(prepare(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Raw extracts: a CSV with untidy headers, quoted signs and unparsable dates, made from the orders.

REMARK = "o_orderpriority || ', \"' || o_orderstatus || '\"; ' || CAST(o_custkey AS {text})"


@query("raw_ingest", f"""SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, CASE WHEN o_orderkey % 13 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created_date,
    {REMARK.format(text='VARCHAR')} AS problem_formerly_complaint_type, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status FROM orders""")
def raw_ingest(spark, sf):
    path = _folder(spark, "extract")
    orders = V.table(spark, sf, "orders")
    dates = F.when(F.col("o_orderkey") % 13 == 0, "no date").otherwise(F.date_format("o_orderdate", "M/d/yyyy h:mm:ss a"))
    untidy = orders.select(
        F.col("o_orderkey").alias(" Unique Key"), dates.alias("Created  Date"), F.expr(REMARK.format(text="STRING")).alias("Problem (formerly Complaint Type)"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("STATUS"))
    untidy.write.option("header", True).option("escape", '"').csv(path)
    return raw.read_raw(spark, path)


@query("broken_line_ingest", """SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority
    ELSE o_orderpriority || chr(10) || '"' || o_orderstatus || '",' || chr(10) || chr(10) || CAST(o_custkey AS VARCHAR) END AS remark FROM orders""")
def broken_line_ingest(spark, sf):
    """Values over several lines, read by many tasks a file."""
    path = _folder(spark, "broken")
    remark = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderpriority || chr(10) || '\"' || o_orderstatus || '\",' || chr(10) || chr(10) || CAST(o_custkey AS STRING) END")
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("Unique Key"), remark.alias("Remark"))
    orders.write.option("header", True).option("escape", '"').csv(path)
    return raw.read_raw(spark, path, multi_line=True)


@query("year_folders", "SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, strftime(o_orderdate, '%Y') AS created_year FROM orders WHERE year(o_orderdate) IN (1996, 1998)")
def year_folders(spark, sf):
    path = _folder(spark, "years")
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("unique_key"), F.col("o_orderdate").alias("created_date"), "o_orderstatus")
    raw.write_by_year(orders, path)
    return raw.read_years(spark, path, [1996, 1998], ["unique_key", "created_year"]).withColumn("created_year", F.col("created_year").cast("string"))


@query("stage_projection", with_(S.ENRICHED, "SELECT unique_key, complaint_type, borough FROM enriched"))
def stage_projection(spark, sf):
    folder = _folder(spark, "stages")
    paths = tables.publish({"requests": V.enriched(spark, sf)}, folder)
    tables.require_inputs(spark, list(paths.values()))
    narrow = tables.write_projection(spark, paths["requests"], ["unique_key", "complaint_type", "borough", "agency"], f"{folder}/narrow")
    return tables.read_table(spark, narrow, ["unique_key", "complaint_type", "borough"])


TOGETHER = ["unique_key", "agency", "complaint_type", "issue_family", "issue_subtype", "subtype_modeled_flag", "resolution_outcome_group", "community_board_code"]


def _bucketed_stages(spark, sf):
    """Requests and their labels as two stage tables in buckets; every ninth request has lost its key."""
    folder = _folder(spark, "buckets")
    rows = V.labelled(spark, sf)
    key = F.when(F.col("unique_key").cast("bigint") % 9 > 0, F.col("unique_key"))
    labels = rows.select(*frames.TAXONOMY_JOIN_COLUMNS)
    requests = rows.drop(*frames.TAXONOMY_JOIN_COLUMNS[1:]).withColumn("unique_key", key)
    buckets = 2 * spark.sparkContext.defaultParallelism
    return (bucketed.write_bucketed(requests, f"{folder}/requests", buckets=buckets),
            bucketed.write_bucketed(labels, f"{folder}/labels", buckets=buckets))


@query("colocated_enrichment", with_(S.ENRICHED, """SELECT CASE WHEN known THEN unique_key END AS unique_key, agency, complaint_type, CASE WHEN known THEN issue_family ELSE complaint_type END AS issue_family,
    CASE WHEN known THEN issue_subtype ELSE 'not_modeled' END AS issue_subtype, known AND subtype_modeled_flag AS subtype_modeled_flag,
    CASE WHEN known THEN resolution_outcome_group ELSE 'unknown' END AS resolution_outcome_group, community_board_code
    FROM (SELECT *, CAST(unique_key AS BIGINT) % 9 > 0 AS known FROM enriched)"""))
def colocated_enrichment(spark, sf):
    return frames.enrich_bucketed(spark, *_bucketed_stages(spark, sf)).select(*TOGETHER)


@query("colocated_columns", with_(S.ENRICHED, """SELECT unique_key, agency, status, issue_subtype FROM enriched WHERE CAST(unique_key AS BIGINT) % 9 > 0"""))
def colocated_columns(spark, sf):
    """Columns of two stage tables by key, first rows per key: groupings and join read bucket by bucket."""
    sides = [bucketed.read_bucketed(spark, path)[0] for path in _bucketed_stages(spark, sf)]
    return tables.assemble_columns(sides, ["unique_key", "agency", "status", "issue_subtype"])


@query("mixed_direction_sort", with_(GRID, """SELECT complaint_type, grid_id, complaints, row_number() OVER (ORDER BY complaint_type, complaints DESC, grid_id) AS position FROM (
    SELECT complaint_type, grid_id, count(*) AS complaints, row_number() OVER (PARTITION BY complaint_type ORDER BY count(*) DESC, grid_id) AS rn
    FROM placed WHERE complaint_type IN (SELECT complaint_type FROM placed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) GROUP BY 1, 2) WHERE rn <= 3"""))
def mixed_direction_sort(spark, sf):
    """The order of the written rows as a column: nine rows."""
    spots = geography.hotspots_by_category(_located(spark, sf), "complaint_type", 3, 3, V.GRID)
    ordered = sort_table("complaint_hotspots", spots).withColumn("_place", F.monotonically_increasing_id())
    return ordered.select("complaint_type", "grid_id", "complaints", F.row_number().over(Window.orderBy("_place")).cast("bigint").alias("position"))


# Geography -----------------------------------------------------------------------

_CORNER = "CAST({x} AS VARCHAR) || ' ' || CAST({y} AS VARCHAR)"
_RING = " || ', ' || ".join(_CORNER.format(x=f"grid_lon_{x}", y=f"grid_lat_{y}") for x, y in (("max", "min"), ("max", "max"), ("min", "max"), ("min", "min"), ("max", "min")))


@query("grid_polygons", with_(GRID, f"SELECT DISTINCT grid_id, 'POLYGON ((' || {_RING} || '))' AS geometry_wkt FROM hot"))
def grid_polygons(spark, sf):
    monthly = geography.grid_monthly(_located(spark, sf), V.GRID)
    return geography.grid_persistence(monthly).select("grid_id", "geometry_wkt")


@query("largest_hotspot_share", with_(GRID, """SELECT max(share) AS hotspot_month_share FROM (SELECT count(*) FILTER (WHERE is_hotspot) / CAST(count(*) AS DOUBLE) AS share FROM hot GROUP BY grid_id)"""))
def largest_hotspot_share(spark, sf):
    return summaries.largest_hotspot_share(geography.grid_persistence(geography.grid_monthly(_located(spark, sf), V.GRID)))


@query("modeled_board_leaders", with_(S.ENRICHED + ", modeled_rows AS (SELECT * FROM enriched WHERE subtype_modeled_flag)",
    f"SELECT top_issue_subtype AS issue_subtype, count(*) AS boards FROM ({BOARD_METRICS_SQL.replace('FROM enriched', 'FROM modeled_rows')}) WHERE top_issue_subtype <> 'not_modeled' GROUP BY 1"))
def modeled_board_leaders(spark, sf):
    """Leaders among the requests of modelled families, so that boards have one."""
    modeled = V.enriched(spark, sf).where("subtype_modeled_flag")
    return summaries.leader_counts(geography.board_metrics(modeled))


# Forecast selections ---------------------------------------------------------------

CONSTANT = "constant AS (SELECT * REPLACE ('30+ days' AS predicted_resolution_bucket) FROM predictions)"
RUNS = [(model, name) for model in ("rule", "constant") for name in ("post_routing", "intake_only")]
SOURCES = PREDICTED + "," + CONSTANT + ", " + ", ".join(
    f"{model}_{name} AS (SELECT * FROM {'predictions' if model == 'rule' else 'constant'} WHERE feature_set = '{name}')" for model, name in RUNS)
REPORTS = SOURCES + ", reports AS (" + " UNION ALL ".join(
    f"SELECT * FROM (WITH nothing AS (SELECT 1) {_report_sql(f'{model}_{name}', model, name)})" for model, name in RUNS) + ")"
BEST = """best AS (SELECT * FROM reports WHERE metric_scope = 'overall' AND metric = 'macro_f1'
  QUALIFY row_number() OVER (PARTITION BY feature_set ORDER BY metric_value DESC, model_name) = 1)"""


def _reports(spark, sf):
    frame = model_rows(spark, sf)
    rows = _with_train_rows(frame.where(F.col("created_year") == BASE))
    rule = _predictions(spark, sf)
    constant = rule.withColumn("predicted_resolution_bucket", F.lit("30+ days"))
    return rounded(forecast.union_all([
        forecast.classification_report(frame.where(F.col("feature_set") == name), BUCKET_ORDER, model, name, rows)
        for model, frame in (("rule", rule), ("constant", constant)) for name in ("post_routing", "intake_only")]), "metric_value")


@query("best_models", with_(REPORTS + ", " + BEST, "SELECT * FROM best"))
def best_models(spark, sf):
    return forecast.best_models(_reports(spark, sf))


@query("best_class_metrics", with_(REPORTS + ", " + BEST, """SELECT r.* FROM reports r JOIN best b ON r.feature_set = b.feature_set AND r.model_name = b.model_name WHERE r.metric_scope = 'class'"""))
def best_class_metrics(spark, sf):
    return forecast.best_class_metrics(_reports(spark, sf))


@query("class_metric_view", with_(REPORTS, "SELECT target_class, metric_value FROM reports WHERE metric_scope = 'class' AND metric = 'f1' AND feature_set = 'post_routing' AND model_name = 'rule'"))
def class_metric_view(spark, sf):
    return forecast.class_metric_view(_reports(spark, sf), "f1", "post_routing", "rule")


@query("prediction_table", with_(PREDICTED + "," + CONSTANT, """SELECT unique_key, resolution_bucket, predicted_resolution_bucket, 'rule' AS model_name, 'post_routing' AS feature_set FROM predictions
    UNION ALL SELECT unique_key, resolution_bucket, predicted_resolution_bucket, 'constant', 'intake_only' FROM constant"""))
def prediction_table(spark, sf):
    rule = _predictions(spark, sf).withColumns({"feature_set": F.lit("post_routing"), "model_name": F.lit("rule")})
    constant = rule.withColumns({"feature_set": F.lit("intake_only"), "model_name": F.lit("constant"), "predicted_resolution_bucket": F.lit("30+ days")})
    columns = ["unique_key", "resolution_bucket", "predicted_resolution_bucket", "model_name", "feature_set"]
    return sort_table("predictions", forecast.union_all([rule, constant])).select(*columns)


@query("out_of_time_split", with_(FRAME + f""", turns AS (SELECT unique_key, resolution_bucket, count(*) OVER () AS total, count(*) OVER (PARTITION BY resolution_bucket) AS n,
    row_number() OVER (PARTITION BY resolution_bucket ORDER BY md5(unique_key || ':42'), unique_key) AS turn FROM train),
picked AS (SELECT unique_key, resolution_bucket FROM turns ORDER BY turn > least(greatest(1, round_even(500e0 * n / total, 0)), n), md5(unique_key || ':43'), unique_key LIMIT 500)""",
    "SELECT unique_key, resolution_bucket, 'train' AS part FROM picked UNION ALL SELECT unique_key, resolution_bucket, 'test' FROM test"))
def out_of_time_split(spark, sf):
    """The fitting sample is bounded by a parameter of the operator; the test year is whole."""
    train, test = forecast.split_by_year(model_rows(spark, sf), V.SCOPE, train_size=500)
    parts = [frame.select("unique_key", "resolution_bucket", F.lit(name).alias("part")) for name, frame in (("train", train), ("test", test))]
    return forecast.union_all(parts)
