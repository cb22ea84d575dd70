"""Forecast frames, encoders, models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import sql as S
from fixtures import views as V
from fixtures.registry import query, rounded
from fixtures.sql import BASE, PARTIAL, quote, with_
from reqlens.contracts import BUCKET_ORDER, FEATURE_SETS, POST_ROUTING_FEATURES
from reqlens.operators import filters, forecast, sampling

_FEATURE = {name: f"CAST({name} AS VARCHAR)" for name in POST_ROUTING_FEATURES}
_FEATURE["borough"] = "upper(borough)"
_FEATURE["subtype_modeled_flag"] = "CASE WHEN subtype_modeled_flag THEN 'modeled' ELSE 'not_modeled' END"
FRAME = S.ENRICHED + f""",
frame AS (SELECT unique_key, created_date, created_year, resolution_bucket, {', '.join(f"coalesce({v}, 'Unknown') AS {k}" for k, v in _FEATURE.items())}
  FROM enriched WHERE resolution_bucket IS NOT NULL AND created_year IN ({BASE}, {PARTIAL})),
train AS (SELECT * FROM frame WHERE created_year = {BASE}), test AS (SELECT * FROM frame WHERE created_year = {PARTIAL})"""
BUCKETS = ", ".join(quote(b) for b in BUCKET_ORDER)


def _frame(spark, sf):
    return forecast.model_frame(V.enriched(spark, sf), V.SCOPE)


def _split(spark, sf):
    """Whole years: the fixture is far below the sampling sizes."""
    frame = _frame(spark, sf)
    return frame.where(F.col("created_year") == BASE), frame.where(F.col("created_year") == PARTIAL)


@query("model_frame", with_(FRAME, f"SELECT unique_key, created_year, resolution_bucket, {', '.join(POST_ROUTING_FEATURES)} FROM frame"))
def model_frame(spark, sf):
    return _frame(spark, sf).select("unique_key", "created_year", "resolution_bucket", *POST_ROUTING_FEATURES)


@query("class_weights", with_(FRAME, """SELECT resolution_bucket, count(*) AS class_rows, round(CAST(sum(count(*)) OVER () AS DOUBLE) / count(*), 6) AS tree_weight,
    round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS logistic_weight FROM train GROUP BY 1"""))
def class_weights(spark, sf):
    train, _ = _split(spark, sf)
    return rounded(forecast.class_weights(train), "tree_weight", "logistic_weight")


TOP_LEVELS = """zips AS (SELECT incident_zip_clean AS v FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 40),
  descriptors AS (SELECT descriptor AS v FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"""


@query("level_cap", with_(FRAME + "," + TOP_LEVELS, """SELECT unique_key, CASE WHEN incident_zip_clean IN (FROM zips) THEN incident_zip_clean ELSE 'other' END AS incident_zip_clean,
    CASE WHEN descriptor IN (FROM descriptors) THEN descriptor ELSE 'other' END AS descriptor FROM test"""))
def level_cap(spark, sf):
    train, test = _split(spark, sf)
    capped = forecast.cap_levels(test, train, {"incident_zip_clean": 40, "descriptor": 5})
    return capped.select("unique_key", "incident_zip_clean", "descriptor")


@query("rare_levels", with_(FRAME + """, z AS (SELECT incident_zip_clean AS v, count(*) AS n FROM train GROUP BY 1)""",
    "SELECT unique_key, CASE WHEN n >= 12 THEN incident_zip_clean WHEN n IS NOT NULL THEN 'infrequent' END AS incident_zip_clean FROM test LEFT JOIN z ON incident_zip_clean = v"))
def rare_levels(spark, sf):
    train, test = _split(spark, sf)
    return forecast.group_rare_levels(test, train, ["incident_zip_clean"], 12).select("unique_key", "incident_zip_clean")


@query("ordinal_encoding", with_(FRAME + """, z AS (SELECT descriptor AS v, row_number() OVER (ORDER BY descriptor) - 1 AS code FROM (SELECT DISTINCT descriptor FROM train))""",
    "SELECT unique_key, CAST(coalesce(code, -1) AS INTEGER) AS descriptor FROM test LEFT JOIN z ON descriptor = v"))
def ordinal_encoding(spark, sf):
    train, test = _split(spark, sf)
    return forecast.ordinal_encode(test, train, ["descriptor"]).select("unique_key", "descriptor")


# A deterministic stand-in for a fitted model: a rule of the request key, with a probability.
RULE_PREDICTION = f"""scored AS (SELECT *, [{BUCKETS}][CAST(1 + (CAST(unique_key AS BIGINT) * 7 + created_year) % 5 AS INTEGER)] AS guess,
  (CAST(unique_key AS BIGINT) * 37 % 1000) / 1000e0 AS predicted_probability FROM test),
predictions AS (SELECT * EXCLUDE (guess), CASE WHEN CAST(unique_key AS BIGINT) % 3 = 0 THEN guess ELSE '30+ days' END AS predicted_resolution_bucket,
  CASE WHEN CAST(unique_key AS BIGINT) % 3 = 0 THEN guess ELSE '30+ days' END = resolution_bucket AS correct_prediction_flag,
  CASE WHEN CAST(unique_key AS BIGINT) % 2 = 0 THEN 'post_routing' ELSE 'intake_only' END AS feature_set FROM scored)"""
PREDICTED = FRAME + "," + RULE_PREDICTION


def _predictions(spark, sf):
    _, test = _split(spark, sf)
    key = F.col("unique_key").cast("bigint")
    labels = F.array(*[F.lit(b) for b in BUCKET_ORDER])
    guess = F.get(labels, ((key * 7 + F.col("created_year")) % 5).cast("int"))
    predicted = F.when(key % 3 == 0, guess).otherwise(F.lit("30+ days"))
    return test.withColumns({
        "predicted_probability": (key * 37 % 1000) / F.lit(1000.0),
        "predicted_resolution_bucket": predicted,
        "feature_set": F.when(key % 2 == 0, "post_routing").otherwise("intake_only"),
    }).withColumn("correct_prediction_flag", F.col("predicted_resolution_bucket") == F.col("resolution_bucket"))


def _report_sql(source: str, model: str, feature_set: str) -> str:
    return f"""
, labels AS (SELECT DISTINCT resolution_bucket AS label FROM {source} UNION SELECT DISTINCT predicted_resolution_bucket FROM {source}),
classes AS (SELECT unnest([{BUCKETS}]) AS label),
scores AS (SELECT label, label IN (SELECT label FROM labels) AS in_data,
    (SELECT count(*) FROM {source} WHERE resolution_bucket = label) AS support, (SELECT count(*) FROM {source} WHERE predicted_resolution_bucket = label) AS claimed,
    (SELECT count(*) FROM {source} WHERE resolution_bucket = label AND predicted_resolution_bucket = label) AS tp
  FROM (SELECT label FROM labels UNION SELECT label FROM classes)),
rated AS (SELECT *, CASE WHEN claimed > 0 THEN tp / CAST(claimed AS DOUBLE) ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS r,
    CASE WHEN support + claimed > 0 THEN 2 * tp / CAST(support + claimed AS DOUBLE) ELSE 0 END AS f FROM scores),
report AS (
  SELECT 'overall' AS metric_scope, NULL AS target_class, 'accuracy' AS metric, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS metric_value FROM rated WHERE in_data
  UNION ALL SELECT 'overall', NULL, 'macro_f1', avg(f) FROM rated WHERE in_data
  UNION ALL SELECT 'overall', NULL, 'weighted_f1', sum(f * support) / CAST(sum(support) AS DOUBLE) FROM rated WHERE in_data
  UNION ALL SELECT 'class', label, 'precision', p FROM rated WHERE label IN (FROM classes)
  UNION ALL SELECT 'class', label, 'recall', r FROM rated WHERE label IN (FROM classes)
  UNION ALL SELECT 'class', label, 'f1', f FROM rated WHERE label IN (FROM classes)
  UNION ALL SELECT 'class', label, 'support', CAST(support AS DOUBLE) FROM rated WHERE label IN (FROM classes))
SELECT '{model}' AS model_name, '{feature_set}' AS feature_set, metric_scope, target_class, metric, round(metric_value, 6) AS metric_value,
  (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM {source}) AS test_rows FROM report"""


def _with_train_rows(train):
    return train.agg(F.count(F.lit(1)).alias("n")).scalar()


MAJORITY = FRAME + """, majority AS (SELECT *, (SELECT resolution_bucket FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS predicted_resolution_bucket FROM test)"""


@query("majority_report", "WITH " + MAJORITY.strip() + _report_sql("majority", "most_frequent_baseline", "shared"))
def majority_report(spark, sf):
    train, test = _split(spark, sf)
    predictions = forecast.majority_predictions(train, test)
    return rounded(forecast.classification_report(predictions, BUCKET_ORDER, "most_frequent_baseline", "shared", _with_train_rows(train)), "metric_value")


@query("classification_report", "WITH " + PREDICTED.strip() + _report_sql("predictions", "rule", "post_routing"))
def classification_report(spark, sf):
    train, _ = _split(spark, sf)
    return rounded(forecast.classification_report(_predictions(spark, sf), BUCKET_ORDER, "rule", "post_routing", _with_train_rows(train)), "metric_value")


@query("confusion_dense", with_(PREDICTED, f"""SELECT a AS actual_resolution_bucket, p AS predicted_resolution_bucket, count(unique_key) AS complaints,
    CAST(sum(count(unique_key)) OVER (PARTITION BY a) AS BIGINT) AS actual_bucket_total,
    CASE WHEN sum(count(unique_key)) OVER (PARTITION BY a) > 0 THEN count(unique_key) / CAST(sum(count(unique_key)) OVER (PARTITION BY a) AS DOUBLE) END AS actual_bucket_share,
    'rule' AS model_name, 'post_routing' AS feature_set
    FROM (SELECT unnest([{BUCKETS}]) AS a) CROSS JOIN (SELECT unnest([{BUCKETS}]) AS p) LEFT JOIN predictions ON resolution_bucket = a AND predicted_resolution_bucket = p GROUP BY 1, 2"""))
def confusion_dense(spark, sf):
    return forecast.confusion_matrix(_predictions(spark, sf), BUCKET_ORDER, "rule", "post_routing")


@query("confusion_pivot", with_(PREDICTED, f"""SELECT resolution_bucket AS actual_resolution_bucket, {', '.join(
    f'count(*) FILTER (WHERE predicted_resolution_bucket = {quote(b)}) / CAST(count(*) AS DOUBLE) AS "to {b}"' for b in BUCKET_ORDER)} FROM predictions GROUP BY 1"""))
def confusion_pivot(spark, sf):
    from reqlens.operators.ranking import pivot_wide

    dense = forecast.confusion_matrix(_predictions(spark, sf), BUCKET_ORDER, "rule", "post_routing")
    wide = pivot_wide(dense, "actual_resolution_bucket", "predicted_resolution_bucket", {b: f"to {b}" for b in BUCKET_ORDER}, "actual_bucket_share")
    return wide.where(F.col("`to 30+ days`").isNotNull())


SLICES = ["complaint_type", "agency", "borough", "issue_family"]


@query("error_slices", with_(PREDICTED + ", sliced AS (" + " UNION ALL ".join(
    f"SELECT feature_set, '{c}' AS segment_column, {c} AS segment_value, resolution_bucket, predicted_resolution_bucket, predicted_probability, correct_prediction_flag FROM predictions" for c in SLICES)
    + """), grouped AS (SELECT feature_set, segment_column, segment_value, count(*) AS complaints, count(*) FILTER (WHERE correct_prediction_flag) / CAST(count(*) AS DOUBLE) AS accuracy,
      round(quantile_cont(predicted_probability, 0.5), 6) AS median_confidence, row_number() OVER (PARTITION BY feature_set, segment_column ORDER BY count(*) DESC, segment_value) AS rn FROM sliced GROUP BY 1, 2, 3)""",
    f"""SELECT g.* EXCLUDE (rn), 'multinomial_logistic' AS model_name, a.top_actual_bucket, p.top_predicted_bucket FROM grouped g
    JOIN {S.mode_table('sliced', ['feature_set', 'segment_column', 'segment_value'], 'resolution_bucket', 'top_actual_bucket')} a USING (feature_set, segment_column, segment_value)
    JOIN {S.mode_table('sliced', ['feature_set', 'segment_column', 'segment_value'], 'predicted_resolution_bucket', 'top_predicted_bucket')} p USING (feature_set, segment_column, segment_value)
    WHERE rn <= 4 AND complaints >= 20"""))
def error_slices(spark, sf):
    return rounded(forecast.error_slices(_predictions(spark, sf), top=4, min_rows=20), "median_confidence")


@query("high_confidence_misses", with_(PREDICTED, """SELECT unique_key, predicted_probability FROM predictions WHERE NOT correct_prediction_flag AND predicted_probability >= 0.9
    ORDER BY predicted_probability DESC, unique_key LIMIT 100"""))
def high_confidence_misses(spark, sf):
    misses = filters.high_confidence_misses(_predictions(spark, sf), 0.9)
    return misses.orderBy(F.desc("predicted_probability"), "unique_key").limit(100).select("unique_key", "predicted_probability")


# Samples: the order of the digests is the same in SQL.


@query("uniform_sample", with_(S.ENRICHED, """SELECT unique_key, created_date, complaint_type FROM enriched
    ORDER BY md5(unique_key || ':42'), unique_key LIMIT 1000"""))
def uniform_sample(spark, sf):
    return sampling.uniform_sample(V.enriched(spark, sf), 1000).select("unique_key", "created_date", "complaint_type")


@query("stratified_sample", with_(S.ENRICHED + """,
turns AS (SELECT unique_key, resolution_bucket, count(*) OVER () AS total, count(*) OVER (PARTITION BY resolution_bucket) AS n,
    row_number() OVER (PARTITION BY resolution_bucket ORDER BY md5(unique_key || ':42'), unique_key) AS turn
  FROM enriched WHERE resolution_bucket IS NOT NULL)""", """SELECT unique_key, resolution_bucket FROM turns
    ORDER BY turn > least(greatest(1, round_even(1000e0 * n / total, 0)), n), md5(unique_key || ':43'), unique_key LIMIT 1000"""))
def stratified_sample(spark, sf):
    frame = V.enriched(spark, sf).where(F.col("resolution_bucket").isNotNull())
    return sampling.stratified_sample(frame, 1000).select("unique_key", "resolution_bucket")


# Fitted models: checked by rows here and by properties in the tests.

def _fitting_split(spark, sf):
    return forecast.split_by_year(_frame(spark, sf), V.SCOPE)


def _logistic(spark, sf, feature_set: str):
    train, test = _fitting_split(spark, sf)
    return forecast.logistic_forecast(train, test, FEATURE_SETS[feature_set], feature_set, min_count=20)


@query("logistic_forecast")
def logistic_forecast(spark, sf):
    predictions, _ = _logistic(spark, sf, "post_routing")
    return rounded(predictions, "predicted_probability", digits=4)


@query("feature_importance")
def feature_importance(spark, sf):
    _, importance = _logistic(spark, sf, "intake_only")
    return rounded(importance, "mean_abs_coefficient", "max_abs_coefficient", digits=4)


@query("tree_forecast")
def tree_forecast(spark, sf):
    train, test = _fitting_split(spark, sf)
    return rounded(forecast.tree_forecast(train, test, FEATURE_SETS["post_routing"], "post_routing"), "predicted_probability", digits=4)


@query("model_comparison")
def model_comparison(spark, sf):
    """Scores of the baseline, the logistic model and the trees for each feature set."""
    train, test = _fitting_split(spark, sf)
    rows, reports = _with_train_rows(train), []
    for name, features in FEATURE_SETS.items():
        logistic, _ = forecast.logistic_forecast(train, test, features, name, min_count=20)
        trees = forecast.tree_forecast(train, test, features, name)
        for model, frame in (("most_frequent_baseline", forecast.majority_predictions(train, test)), ("multinomial_logistic", logistic),
                             ("hist_gradient_boosting", trees)):
            reports.append(forecast.classification_report(frame, BUCKET_ORDER, model, name, rows))
    return rounded(forecast.model_comparison(forecast.union_all(reports)), "accuracy", "macro_f1", "weighted_f1", digits=4)
