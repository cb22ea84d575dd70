import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.contracts import BUCKET_ORDER, Scope
from reqlens.operators import boosting, forecast as P


def predictions(spark):
    pairs = [("<1 day", "<1 day")] * 6 + [("<1 day", "30+ days")] * 2 + [("30+ days", "30+ days")] * 3 + [("1-3 days", "<1 day")]
    return spark.createDataFrame(pairs, f"{P.TARGET} string, {P.PREDICTED} string")


def test_classification_report(spark):
    out = {(r["metric_scope"], r["target_class"], r["metric"]): r["metric_value"]
           for r in P.classification_report(predictions(spark), ["1-3 days", "30+ days", "<1 day", "3-7 days"], "m", "f", 5).collect()}
    assert len(out) == 3 + 4 * 4
    assert out[("overall", None, "accuracy")] == pytest.approx(9 / 12)
    f1 = {"<1 day": 12 / 15, "30+ days": 6 / 8, "1-3 days": 0.0}
    assert out[("overall", None, "macro_f1")] == pytest.approx(sum(f1.values()) / 3)
    assert out[("overall", None, "weighted_f1")] == pytest.approx((8 * f1["<1 day"] + 3 * f1["30+ days"]) / 12)
    assert out[("class", "<1 day", "precision")] == pytest.approx(6 / 7) and out[("class", "<1 day", "recall")] == pytest.approx(6 / 8)
    assert out[("class", "3-7 days", "f1")] == 0.0 and out[("class", "3-7 days", "support")] == 0.0


def test_confusion_is_dense(spark):
    rows = P.confusion_matrix(predictions(spark), BUCKET_ORDER, "m", "f").collect()
    assert len(rows) == 25 and sum(r["complaints"] for r in rows) == 12
    cell = {(r["actual_resolution_bucket"], r["predicted_resolution_bucket"]): r for r in rows}
    assert cell[("<1 day", "30+ days")]["actual_bucket_share"] == 0.25
    assert cell[("3-7 days", "<1 day")]["actual_bucket_total"] == 0 and cell[("3-7 days", "<1 day")]["actual_bucket_share"] is None


def test_encoders(spark):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 1, "x string")
    test = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "x string")
    assert sorted(str(r[0]) for r in P.cap_levels(test, train, {"x": 2}).collect()) == ["a", "b", "other", "other", "other"]
    assert sorted(str(r[0]) for r in P.group_rare_levels(test, train, ["x"], 3).collect()) == ["None", "None", "a", "b", "infrequent"]
    assert sorted(r[0] for r in P.ordinal_encode(test, train, ["x"]).collect()) == [-1, -1, 0, 1, 2]


def test_metric_views(spark):
    rows = [("shared", "b", "overall", None, "macro_f1", 0.9), ("post_routing", "m1", "overall", None, "macro_f1", 0.4),
            ("post_routing", "m2", "overall", None, "macro_f1", 0.5), ("post_routing", "m2", "overall", None, "accuracy", 0.7),
            ("post_routing", "m1", "class", "30+ days", "f1", 0.1), ("post_routing", "m2", "class", "30+ days", "f1", 0.2),
            ("post_routing", "m2", "class", "<1 day", "f1", 0.3)]
    metrics = spark.createDataFrame(rows, "feature_set string, model_name string, metric_scope string, target_class string, metric string, metric_value double")
    assert [(r["feature_set"], r["model_name"]) for r in P.best_models(metrics).collect()] == [("post_routing", "m2")]
    assert {r["metric_value"] for r in P.best_class_metrics(metrics).collect()} == {0.2, 0.3}
    assert [r[0] for r in P.class_metric_view(metrics, "f1", "post_routing", "m2").collect()] == ["<1 day", "30+ days"]
    wide = {r["model_name"]: r for r in P.model_comparison(metrics).collect()}
    assert wide["m2"]["accuracy"] == 0.7 and wide["m1"]["accuracy"] is None


def learnable(spark, n=600):
    """The agency decides the bucket, with a few exceptions."""
    agency = F.concat(F.lit("A"), (F.col("id") % 3).cast("string"))
    bucket = F.when(F.col("id") % 29 == 0, "1-3 days").when(F.col("id") % 3 == 0, "<1 day").when(F.col("id") % 3 == 1, "7-30 days").otherwise("30+ days")
    df = spark.range(n).select(
        F.col("id").cast("string").alias("unique_key"), F.lit("2025-01-01").cast("timestamp_ntz").alias("created_date"),
        F.when(F.col("id") < n * 2 // 3, 2025).otherwise(2026).alias("created_year"), agency.alias("agency"), bucket.alias(P.TARGET),
        (F.col("id") % 3 == 0).alias("subtype_modeled_flag"))
    for name in {*P.POST_ROUTING_FEATURES, *P.PREDICTION_COLUMNS} - set(df.columns):
        df = df.withColumn(name, (F.col("unique_key").cast("int") % 4).cast("string"))
    return P.model_frame(df, Scope("2025-01-01", 2025, 2026))


def test_models_beat_the_baseline(spark):
    scope = Scope("2025-01-01", 2025, 2026)
    train, test = P.split_by_year(learnable(spark), scope)
    features = ["agency", "complaint_type", "subtype_modeled_flag"]
    logistic, importance = P.logistic_forecast(train, test, features, "post_routing", min_count=10)
    trees = P.tree_forecast(train, test, features, "post_routing", rounds=3, leaves=6, min_leaf=5)
    for frame in (logistic, trees):
        assert frame.count() == 200
        assert frame.where("correct_prediction_flag").count() > 120
        assert frame.where("predicted_probability BETWEEN 0.25 AND 1.0").count() == 200
    repeated = P.tree_forecast(train, test.unionByName(test), features, "post_routing", rounds=1, leaves=3, min_leaf=5)
    assert repeated.count() == 400  # rows with one key are scored each
    assert logistic.where("predicted_probability BETWEEN 0.25 AND 1.0").count() == 200
    rows = importance.collect()
    assert {r["feature_group"] for r in rows} == set(features)
    assert all(r["max_abs_coefficient"] >= r["mean_abs_coefficient"] >= 0 for r in rows)
    with pytest.raises(ValueError):
        P.split_by_year(learnable(spark).where("created_year = 2025"), scope)


def test_the_fitting_year_is_whole(spark):
    frame = learnable(spark, 540_000)
    train, test = P.split_by_year(frame, Scope("2025-01-01", 2025, 2026))
    assert (train.count(), test.count()) == (360_000, 180_000)
    part, _ = P.split_by_year(frame, Scope("2025-01-01", 2025, 2026), train_size=1_000)
    assert part.count() == 1_000
    # Ten rows of 360 000 have this level: it is frequent enough only if all of them count.
    few = train.withColumn("agency", F.when(F.col("unique_key").cast("int") % 36_000 == 0, "few").otherwise(F.col("agency")))
    _, importance = P.logistic_forecast(few, test.limit(10), ["agency"], "post_routing", min_count=10)
    assert {r["feature"] for r in importance.collect()} == {"agency_A0", "agency_A1", "agency_A2", "agency_few"}
    trees = P.tree_forecast(train, test.limit(200), ["agency"], "post_routing", rounds=1, leaves=3, min_leaf=5, train_size=500)
    assert trees.count() == 200 and trees.where("correct_prediction_flag").count() > 120


def plain_boosting(codes, labels, counts, weights, classes, rounds, step, leaves, least_rows):
    """The same model by loops over rows, features and levels; returns the margins of the rows."""
    n, total = len(codes), sum(c * w for c, w in zip(counts, weights))
    base = [math.log(sum(c * w for c, w, y in zip(counts, weights, labels) if y == k) / total) for k in range(classes)]
    margins = [base[:] for _ in range(n)]

    def best_split(rows, g, h):
        best = None
        all_g, all_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for feature in range(len(codes[0])):
            levels = sorted({codes[i][feature] for i in rows})
            of = {v: [i for i in rows if codes[i][feature] == v] for v in levels}
            levels.sort(key=lambda v: sum(g[i] for i in of[v]) / (sum(h[i] for i in of[v]) + boosting.SMOOTHING))
            for cut in range(1, len(levels)):
                left = [i for v in levels[:cut] for i in of[v]]
                right = [i for v in levels[cut:] for i in of[v]]
                if min(sum(counts[i] for i in left), sum(counts[i] for i in right)) < least_rows:
                    continue
                gl, hl, gr, hr = (sum(x[i] for i in side) for side in (left, right) for x in (g, h))
                if min(hl, hr) < boosting.LEAST_HESSIAN:
                    continue
                gain = gl ** 2 / hl + gr ** 2 / hr - all_g ** 2 / all_h
                if gain > 1e-10 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, right)
        return best

    for _ in range(rounds):
        shares = []
        for row in margins:
            raised = [math.exp(m - max(row)) for m in row]
            shares.append([r / sum(raised) for r in raised])
        for k in range(classes):
            g = [(shares[i][k] - (labels[i] == k)) * counts[i] * weights[i] for i in range(n)]
            h = [shares[i][k] * (1 - shares[i][k]) * counts[i] * weights[i] for i in range(n)]
            grown = [(list(range(n)), best_split(list(range(n)), g, h))]
            while len(grown) < leaves and any(split for _, split in grown):
                at = max((j for j, (_, split) in enumerate(grown) if split), key=lambda j: grown[j][1][0])
                _, (_, left, right) = grown.pop(at)
                grown += [(left, best_split(left, g, h)), (right, best_split(right, g, h))]
            for rows, _ in grown:
                value = -step * sum(g[i] for i in rows) / sum(h[i] for i in rows)
                for i in rows:
                    margins[i][k] += value
    return margins


@pytest.mark.parametrize("leaves,least_rows", [(4, 1), (6, 8), (63, 3)])
def test_boosting_equals_a_plain_version(leaves, least_rows):
    draw = np.random.default_rng(leaves)
    codes = np.column_stack([draw.integers(0, 4, 70), draw.integers(0, 7, 70), draw.integers(0, 3, 70)]).astype(np.uint8)
    labels = ((codes[:, 0] + codes[:, 1] // 3 + (draw.random(70) < 0.2)) % 3).astype(np.int64)
    counts, weights = 1 + 3 * draw.random(70), np.array([0.5, 1.0, 2.0])[labels]
    model = boosting.fit(codes, labels, counts, weights, 3, rounds=4, step=0.3, leaves=leaves, least_rows=least_rows, early_rows=None)
    wanted = plain_boosting(codes.tolist(), labels.tolist(), counts.tolist(), weights.tolist(), 3, 4, 0.3, leaves, least_rows)
    assert np.allclose(model.margins(codes), wanted, atol=1e-8)
    assert max((tree.feature < 0).sum() for trees in model.rounds for tree in trees) <= leaves
    assert np.allclose(model.probabilities(codes).sum(axis=1), 1)


def test_boosting_of_odd_tables():
    none = boosting.fit(np.zeros((0, 2), np.uint8), np.zeros(0, int), np.zeros(0), np.zeros(0), 2)
    assert none.rounds == [] and none.probabilities(np.zeros((3, 2), np.uint8)).shape == (3, 2)
    one = boosting.fit(np.zeros((5, 1), np.uint8), np.array([0, 0, 1, 1, 1]), np.ones(5), np.ones(5), 2, rounds=2, least_rows=1)
    assert one.probabilities(np.array([[0], [255]], np.uint8))[:, 1] == pytest.approx([0.6, 0.6])
    draw = np.random.default_rng(1)
    codes, labels = draw.integers(0, 5, (300, 2)).astype(np.uint8), draw.integers(0, 2, 300)
    noise = boosting.fit(codes, labels, np.full(300, 50.0), np.ones(300), 2, rounds=200, step=0.5, least_rows=1)
    assert len(noise.rounds) < 200  # nothing to learn: stopped early


def test_codes_of_levels(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", None), ("c", "y"), ("a", "y")], "p string, q string")
    known = boosting.level_codes(train, ["p", "q"], {"p": 2})
    assert known == {"p": ["a", "b"], "q": ["x", "y"]}
    rows = train.unionByName(spark.createDataFrame([("new", None)], train.schema)).select(boosting.code_bytes(known).alias("c")).collect()
    assert [tuple(r["c"]) for r in rows] == [(1, 0), (0, 0), (0, 255), (255, 1), (0, 1), (255, 255)]
