"""Forecasting the resolution bucket: frames, encoders, models and their evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reqlens.contracts import BUCKET_ORDER, DEFAULT_SCOPE, POST_ROUTING_FEATURES, TARGET, Scope
from reqlens.functions.measures import rank_in
from reqlens.operators import boosting
from reqlens.operators.joins import attach
from reqlens.operators.order_statistics import leading_labels, summarize, tally
from reqlens.operators.ranking import count_by, first_per_group
from reqlens.operators.sampling import stratified_sample
from reqlens.session import cut_lineage

OTHER, INFREQUENT = "other", "infrequent"
PREDICTED = "predicted_resolution_bucket"
PREDICTION_COLUMNS = [
    "unique_key", "created_date", "created_year", "complaint_type", "descriptor", "agency", "borough",
    "incident_zip_clean", "community_board", "issue_family", "issue_subtype", TARGET,
]


def model_frame(enriched: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Rows of both years with a target; every feature a string, missing as ``Unknown``."""
    usable = enriched.where(
        F.col(TARGET).isNotNull() & F.col("created_year").isin(scope.base_year, scope.partial_year))
    flag = F.when(F.col("subtype_modeled_flag"), "modeled").otherwise("not_modeled")
    usable = usable.withColumns({"borough": F.upper("borough"), "subtype_modeled_flag": flag})
    return usable.withColumns({
        name: F.coalesce(F.col(name).cast("string"), F.lit("Unknown")) for name in POST_ROUTING_FEATURES})


def split_by_year(frame: DataFrame, scope: Scope = DEFAULT_SCOPE, train_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-time split: fit on the base year, test on the partial year.

    Both years are whole; only with ``train_size`` the fitting rows are a sample of that size. Both are read
    by every model, so they are written once.
    """
    train = frame.where(F.col("created_year") == scope.base_year)
    train = cut_lineage(train if train_size is None else stratified_sample(train, train_size))
    test = cut_lineage(frame.where(F.col("created_year") == scope.partial_year))
    if train.limit(1).count() == 0 or test.limit(1).count() == 0:
        raise ValueError("The training or the test year has no rows.")
    return train, test


def _with_levels(df: DataFrame, column: str, levels: DataFrame, found: Column) -> DataFrame:
    """Replace a column through a table of its levels; the table side may be broadcast by size."""
    table = levels.withColumnsRenamed({column: "_level"})
    return df.join(table, F.col(column) == F.col("_level"), "left").withColumn(column, found).drop(*table.columns)


def cap_levels(df: DataFrame, train: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Keep the most frequent training levels of each column, all others become ``other``."""
    for column, limit in limits.items():
        if column not in train.columns:
            continue
        kept = count_by(train, column, name="_n").orderBy(F.desc("_n"), F.asc(column)).limit(limit)
        df = _with_levels(df, column, kept, F.when(F.col("_level").isNotNull(), F.col(column)).otherwise(OTHER))
    return df


def group_rare_levels(df: DataFrame, train: DataFrame, columns: Sequence[str], min_count: int = 100) -> DataFrame:
    """Training levels below the count become ``infrequent``; levels never seen become null."""
    for column in columns:
        seen = count_by(train, column, name="_n")
        df = _with_levels(df, column, seen, F.when(F.col("_n") >= min_count, F.col(column))
                          .when(F.col("_n").isNotNull(), INFREQUENT))
    return df


def ordinal_encode(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Alphabetical number of each training level, -1 for unknown ones; all columns are numbered by one aggregate."""
    levels = train.unpivot([], list(columns), "feature", "level").where(F.col("level").isNotNull()).distinct()
    numbered = levels.withColumn("_number", F.row_number().over(Window.partitionBy("feature").orderBy("level")) - 1)
    for column in columns:
        numbers = numbered.where(F.col("feature") == column).select(F.col("level").alias(column), "_number")
        df = _with_levels(df, column, numbers, F.coalesce(F.col("_number"), F.lit(-1)))
    return df


def class_weights(train: DataFrame, target: str = TARGET) -> DataFrame:
    """Balancing weights per class: ``tree`` is 1/share, ``logistic`` is rows/(classes*count)."""
    counts = count_by(train, target, name="class_rows")
    rows = F.sum("class_rows").over(Window.partitionBy())
    classes = F.count(F.lit(1)).over(Window.partitionBy())
    return counts.withColumns({
        "tree_weight": rows / F.col("class_rows"),
        "logistic_weight": rows / (classes * F.col("class_rows")),
    })


def majority_predictions(train: DataFrame, test: DataFrame, target: str = TARGET) -> DataFrame:
    """Baseline: every test row gets the most frequent training class."""
    majority = train.agg(F.mode(target, True).alias("m")).scalar()
    return test.withColumn(PREDICTED, majority)


def train_classes(train: DataFrame, target: str = TARGET) -> list[str]:
    """Sorted class labels; a handful of values."""
    return sorted(row[0] for row in train.select(target).distinct().collect())


# Models ------------------------------------------------------------------------


def _label(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    return df.withColumn("label", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(TARGET)) - 1).cast("double"))


def _class_of(index: Column, classes: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def _one_hot(train: DataFrame, test: DataFrame, features: Sequence[str], min_count: int):
    """Folded training rows and test rows: one slot per frequent level and one for rare ones; unseen levels have no slot.

    The fitted vocabulary is model state and lives on the driver, as in every ML encoder: at
    most rows/min_count levels per feature.
    """
    levels = train.unpivot([], list(features), "feature", "level").groupBy("feature", "level").count()
    listed = levels.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.when(F.col("count") >= min_count, F.col("level")))).alias("levels"),
        F.max(F.col("count") < min_count).alias("rare"))
    fitted = {row["feature"]: (row["levels"], row["rare"]) for row in listed.collect()}
    with_rare = [f for f in features if fitted[f][1]]
    labels = [fitted[f][0] + ([INFREQUENT] if f in with_rare else []) for f in features]
    indexers = [StringIndexerModel.from_labels(known, inputCol=f"_g_{f}", outputCol=f"_i_{f}", handleInvalid="keep")
                for f, known in zip(features, labels)]
    encoder = OneHotEncoder(inputCols=[f"_i_{f}" for f in features], outputCols=[f"_v_{f}" for f in features],
                            dropLast=True, handleInvalid="error")
    assembler = VectorAssembler(inputCols=[f"_v_{f}" for f in features], outputCol="features")

    def indexed(df: DataFrame) -> DataFrame:
        return reduce(lambda frame, indexer: indexer.transform(frame), indexers, df)

    # Every training level that is not frequent is rare. A test level may also be unknown, so
    # it is looked up, for the features that have rare levels at all.
    train_indexed = indexed(train.withColumns({
        f"_g_{f}": F.when(F.col(f).isin(fitted[f][0]), F.col(f)).otherwise(INFREQUENT) if f in with_rare else F.col(f)
        for f in features}))
    copies = test.withColumns({f"_g_{f}": F.col(f) for f in features})
    seen = train.withColumns({f"_g_{f}": F.col(f) for f in with_rare})
    test_indexed = indexed(group_rare_levels(copies, seen, [f"_g_{f}" for f in with_rare], min_count))
    fitted_encoder = encoder.fit(train_indexed)
    drop = [f"_{kind}_{f}" for kind in "giv" for f in features]
    names = [(feature, level) for feature, levels in zip(features, labels) for level in levels]
    folded = train_indexed.groupBy(*[f"_i_{f}" for f in features], TARGET).agg(F.count(F.lit(1)).alias("_rows"))
    return (assembler.transform(fitted_encoder.transform(folded)).drop(*drop),
            assembler.transform(fitted_encoder.transform(test_indexed)).drop(*drop), names)


def _prediction_frame(scored: DataFrame, classes: Sequence[str], model: str, feature_set: str) -> DataFrame:
    predicted = scored.withColumn(PREDICTED, _class_of(F.col("prediction"), classes))
    of_classes = F.col("probability")
    if not isinstance(scored.schema["probability"].dataType, T.ArrayType):
        of_classes = vector_to_array(of_classes)
    probability = F.array_max(of_classes)
    return predicted.select(
        *PREDICTION_COLUMNS, PREDICTED, probability.alias("predicted_probability"),
        (F.col(TARGET) == F.col(PREDICTED)).alias("correct_prediction_flag"),
        F.lit(model).alias("model_name"), F.lit(feature_set).alias("feature_set"))


IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("feature_set", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("feature_group", T.StringType()),
    T.StructField("mean_abs_coefficient", T.DoubleType()),
    T.StructField("max_abs_coefficient", T.DoubleType()),
    T.StructField("strongest_class", T.StringType()),
])


def logistic_forecast(train: DataFrame, test: DataFrame, features: Sequence[str], feature_set: str,
                      strength: float = 0.35, iterations: int = 800, tolerance: float = 3e-3,
                      min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """Balanced multinomial logistic regression: (predictions, feature importance).

    Equal feature rows of a class are fitted once, weighted by their number. The penalty is rescaled to the
    per-row loss: balanced weights sum to the row count.
    """
    classes = train_classes(train)
    encoded, scored_input, names = _one_hot(train, test, features, min_count)
    weights = class_weights(train).select(F.col(TARGET).alias("_class"), F.col("logistic_weight").alias("_weight"))
    weighted = encoded.join(weights, F.col(TARGET) == F.col("_class")).withColumn("_weight", F.col("_weight") * F.col("_rows"))
    fitting = _label(weighted, classes).select("features", "label", "_weight").persist()
    penalty = 1.0 / (strength * train.count())
    model = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=0.0, standardization=False,
                               maxIter=iterations, tol=tolerance, weightCol="_weight").fit(fitting)
    fitting.unpersist()
    predictions = _prediction_frame(model.transform(scored_input), classes, "multinomial_logistic", feature_set)
    return predictions, feature_importance(train.sparkSession, model.coefficientMatrix.toArray(), names, classes,
                                           "multinomial_logistic", feature_set)


def feature_importance(spark, coefficients, names, classes, model: str, feature_set: str) -> DataFrame:
    """Mean and largest absolute coefficient of every feature over the classes."""
    rows = []
    for position, (group, level) in enumerate(names):
        column = [abs(float(coefficients[c][position])) for c in range(len(classes))]
        strongest = classes[column.index(max(column))]
        rows.append((model, feature_set, f"{group}_{level}", group, sum(column) / len(column), max(column), strongest))
    return spark.createDataFrame(rows, IMPORTANCE_SCHEMA)


TREE_LEVEL_LIMITS = {"descriptor": 250, "incident_zip_clean": 250}


def tree_forecast(train: DataFrame, test: DataFrame, features: Sequence[str], feature_set: str,
                  rounds: int = 200, step: float = 0.08, leaves: int = 63, min_leaf: int = 200,
                  limits: Mapping[str, int] = TREE_LEVEL_LIMITS, train_size: int = 350_000) -> DataFrame:
    """Boosted trees over all classes on capped categorical features, with balanced weights.

    Trees grow on the driver, so they alone are fitted on a sample of ``train_size`` rows. Every row of ``test`` is
    scored; levels beyond the limits, unseen ones and nulls share one code.
    """
    spark = train.sparkSession
    sample = stratified_sample(train, train_size)
    train = sample if sample is train else cut_lineage(sample)  # the whole table is a written one already
    classes = train_classes(train)
    known = boosting.level_codes(train, features, dict(limits))
    codes = boosting.code_bytes(known)
    weights = {row[TARGET]: row["tree_weight"] for row in class_weights(train).collect()}
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(TARGET)) - 1
    model = boosting.fit_table(train, codes, label, len(features), np.array([weights[c] for c in classes]), rounds=rounds,
                               step=step, leaves=leaves, least_rows=min_leaf)
    scored = test.withColumn("probability", boosting.probability_column(model, codes, len(features), spark))
    first_best = F.array_position("probability", F.array_max("probability")) - 1
    return _prediction_frame(scored.withColumn("prediction", first_best), classes, "hist_gradient_boosting", feature_set)


# Evaluation --------------------------------------------------------------------


def classification_report(predictions: DataFrame, classes: Sequence[str], model: str, feature_set: str,
                          train_rows: int | Column, target: str = TARGET, predicted: str = PREDICTED) -> DataFrame:
    """Accuracy, macro and weighted F1, and per-class scores, long format.

    One small table of (actual, predicted) counts feeds everything; an undefined score is 0.
    """
    confusion = predictions.groupBy(F.col(target).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("claimed"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("claimed"), zero.alias("tp")))
    per_label = confusion.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("tp").alias("tp"))
    listed = predictions.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    scores = per_label.withColumn("in_data", F.lit(True)).join(listed.withColumn("in_model", F.lit(True)), "label", "full")
    scores = scores.fillna(0, ["support", "claimed", "tp"]).fillna(False, ["in_data", "in_model"])

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))

    scores = scores.withColumns({
        "precision": ratio(F.col("tp"), F.col("claimed")),
        "recall": ratio(F.col("tp"), F.col("support")),
        "f1": ratio(F.col("tp") * 2, F.col("support") + F.col("claimed")),
    })
    overall = scores.where("in_data").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    ).select(F.lit("overall").alias("metric_scope"), F.lit(None).cast("string").alias("target_class"), "*")
    per_class = scores.where("in_model").select(
        F.lit("class").alias("metric_scope"), F.col("label").alias("target_class"),
        "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    ids = ["metric_scope", "target_class"]
    stacked = overall.unpivot(ids, ["accuracy", "macro_f1", "weighted_f1"], "metric", "metric_value").unionByName(
        per_class.unpivot(ids, ["precision", "recall", "f1", "support"], "metric", "metric_value"))
    test_rows = predictions.agg(F.count(F.lit(1)).alias("n")).scalar()
    train_count = F.lit(train_rows).cast("bigint") if isinstance(train_rows, int) else train_rows
    return stacked.select(
        F.lit(model).alias("model_name"), F.lit(feature_set).alias("feature_set"), *ids, "metric", "metric_value",
        train_count.alias("train_rows"), test_rows.alias("test_rows"))


def confusion_matrix(predictions: DataFrame, classes: Sequence[str], model: str, feature_set: str,
                     target: str = TARGET, predicted: str = PREDICTED) -> DataFrame:
    """All class pairs, zero cells included, with row totals and shares."""
    listed = F.array(*[F.lit(c) for c in classes])
    pairs = predictions.sparkSession.range(1).select(F.explode(listed).alias("actual_resolution_bucket")).withColumn(
        "predicted_resolution_bucket", F.explode(listed))
    counts = predictions.groupBy(
        F.col(target).alias("actual_resolution_bucket"), F.col(predicted).alias("predicted_resolution_bucket")
    ).agg(F.count(F.lit(1)).alias("complaints"))
    dense = pairs.join(counts, ["actual_resolution_bucket", "predicted_resolution_bucket"], "left").fillna(0, ["complaints"])
    total = F.sum("complaints").over(Window.partitionBy("actual_resolution_bucket"))
    return dense.withColumn("actual_bucket_total", total).withColumns({
        "actual_bucket_share": F.when(F.col("actual_bucket_total") > 0, F.col("complaints") / F.col("actual_bucket_total")),
        "model_name": F.lit(model), "feature_set": F.lit(feature_set)})


SLICE_COLUMNS = ["complaint_type", "agency", "borough", "issue_family"]


def error_slices(predictions: DataFrame, columns: Sequence[str] = SLICE_COLUMNS, top: int = 25,
                 min_rows: int = 1000, model: str = "multinomial_logistic") -> DataFrame:
    """Accuracy and confidence of the largest segment values of each column."""
    sliced = predictions.select(
        "feature_set", TARGET, PREDICTED, "predicted_probability", "correct_prediction_flag",
        F.explode(F.array(*[F.struct(F.lit(c).alias("segment_column"), F.col(c).alias("segment_value"))
                            for c in columns])).alias("s")).select("*", "s.*").drop("s")
    sliced = sliced.where(F.col("segment_value").isNotNull())
    keys = ["feature_set", "segment_column", "segment_value"]
    tallied = tally(sliced, keys, {"correct": F.col("correct_prediction_flag")}, F.col("predicted_probability"),
                    bin_width=1.0 / 1024, labels={TARGET: F.col(TARGET), PREDICTED: F.col(PREDICTED)})
    measured = summarize(tallied, keys, "complaints", ["correct"], {"median_confidence": 0.5})
    leaders = {"top_actual_bucket": TARGET, "top_predicted_bucket": PREDICTED}
    labels = leading_labels(tallied, keys, leaders)
    largest = first_per_group(measured, keys[:2], top, F.desc("complaints"), F.asc("segment_value"))
    kept = largest.where(F.col("complaints") >= min_rows).transform(
        lambda rows: attach(rows, labels, keys)).fillna("Unknown", list(leaders))
    return kept.withColumns({
        "accuracy": F.col("correct") / F.col("complaints"), "model_name": F.lit(model)}).drop("correct")


def best_models(metrics: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Best non-baseline model of each feature set."""
    rows = metrics.where((F.col("metric_scope") == "overall") & (F.col("metric") == metric)
                         & (F.col("feature_set") != "shared"))
    return first_per_group(rows, ["feature_set"], 1, F.desc("metric_value"), F.asc("model_name"))


def best_class_metrics(metrics: DataFrame) -> DataFrame:
    """Class scores of the best model of each feature set."""
    best = best_models(metrics).select("feature_set", "model_name")
    return metrics.where(F.col("metric_scope") == "class").join(best, ["feature_set", "model_name"], "left_semi")


def model_comparison(metrics: DataFrame) -> DataFrame:
    overall = metrics.where((F.col("metric_scope") == "overall") & (F.col("feature_set") != "shared"))
    names = ["accuracy", "macro_f1", "weighted_f1"]
    return overall.groupBy("feature_set", "model_name").agg(
        *[F.max(F.when(F.col("metric") == name, F.col("metric_value"))).alias(name) for name in names])


def class_metric_view(metrics: DataFrame, metric: str, feature_set: str, model: str) -> DataFrame:
    chosen = metrics.where((F.col("metric_scope") == "class") & (F.col("metric") == metric)
                           & (F.col("feature_set") == feature_set) & (F.col("model_name") == model))
    return chosen.select("target_class", "metric_value").orderBy(rank_in("target_class", BUCKET_ORDER), "target_class")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)
