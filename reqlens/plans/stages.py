"""The analysis stages, from raw requests to published tables.

Every stage takes DataFrames and returns named, lazily evaluated DataFrames. ``publish_stage``
sorts and writes them. Stages hand over through written tables, so a lost executor costs at
most the stage it was working on.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqlens.contracts import (
    CORE_PROJECTION, DEFAULT_BOX, DEFAULT_SCOPE, FEATURE_SET_ORDER, FEATURE_SETS, GEO_PROJECTION,
    GRID_SIZE_DEGREES, MODEL_ORDER, BUCKET_ORDER, SEASON_ORDER, TAXONOMY_COLUMNS, TAXONOMY_PROJECTION,
    WEEKDAY_ORDER, Box, Scope)
from reqlens.functions.lifecycle import valid_coordinate
from reqlens.functions.measures import order_by_rank
from reqlens.operators import (
    equity, forecast, frames, geography, ngrams, scorecards, summaries, taxonomy)
from reqlens.operators.ranking import count_by, top_counts
from reqlens.rules import MISMATCH_RULES, OUTCOME_RULES, SUBTYPE_RULES
from reqlens.sources.bucketed import BUCKETS, HAS_KEY, read_bucketed, write_bucketed
from reqlens.sources.raw import read_years
from reqlens.sources.tables import assert_unique, publish, read_table, write_projection, write_table

Tables = dict[str, DataFrame]

# Sort keys of the published tables: "-" marks descending, nulls are last either way.
SORT_KEYS: dict[str, list[str]] = {
    "agency_metrics": ["-complaints", "agency", "agency_name"],
    "complaint_type_metrics": ["-complaints", "complaint_type"],
    "agency_issue_metrics": ["issue_level", "-issue_complaints", "-complaints", "issue_value", "agency"],
    "operations_monthly": ["created_month_start"],
    "community_board_operations": ["community_board_borough", "-complaints", "community_board"],
    "community_board_metrics": ["community_board_borough", "-complaints", "community_board"],
    "zcta_fairness_metrics": ["-complaints", "zcta"],
    "zcta_fairness_stratified": ["issue_level", "-benchmark_complaints", "-complaints", "issue_value", "agency", "zcta"],
    "zcta_fairness_monthly": ["zcta", "created_month_start"],
    "community_board_fairness_sensitivity": ["community_board_borough", "-complaints", "community_board"],
    "fairness_model_results": ["model_name", "feature"],
    "monthly": ["created_month_start"],
    "monthly_by_type": ["created_month_start", "complaint_type"],
    "top_complaint_types": ["-complaints", "complaint_type"],
    "hourly": ["created_hour"],
    "borough_counts": ["-complaints", "borough"],
    "borough_mix": ["borough", "-complaints", "complaint_type"],
    "descriptor_counts": ["-complaints", "descriptor"],
    "issue_families": ["-complaints", "issue_family"],
    "modeled_subtypes": ["-complaints", "issue_subtype"],
    "subtype_source": ["-complaints", "subtype_source"],
    "outcome_groups": ["-complaints", "resolution_outcome_group"],
    "outcome_confidence": ["-complaints", "resolution_outcome_confidence"],
    "complaint_type_coverage": ["-complaints", "complaint_type"],
    "residual_counts": ["-complaints", "residual_cluster_label"],
    "outcome_by_complaint_type": ["resolution_outcome_group", "-complaints", "complaint_type"],
    "outcome_by_agency": ["resolution_outcome_group", "-complaints", "agency"],
    "board_top_subtypes": ["-boards", "issue_subtype"],
    "borough_coverage": ["-complaints", "borough"],
    "hotspot_monthly": ["created_month_start"],
    "complaint_hotspots": ["complaint_type", "-complaints", "grid_id"],
    "subtype_hotspots": ["issue_subtype", "-complaints", "grid_id"],
}
RANKED_KEYS = {
    "seasonal": [("created_season", SEASON_ORDER), "year_label"],
    "weekday_hour": [("created_weekday", WEEKDAY_ORDER), "created_hour"],
    "resolution_bucket_counts": [("resolution_bucket", [*BUCKET_ORDER, "Missing"])],
    "model_metrics": [("feature_set", FEATURE_SET_ORDER), ("model_name", MODEL_ORDER), "metric_scope",
                      ("target_class", BUCKET_ORDER), "metric"],
    "predictions": [("feature_set", FEATURE_SET_ORDER), ("model_name", MODEL_ORDER), "created_date", "unique_key"],
    "feature_importance": [("feature_set", FEATURE_SET_ORDER), ("model_name", MODEL_ORDER),
                           "-mean_abs_coefficient", "feature"],
    "error_slices": [("feature_set", FEATURE_SET_ORDER), ("model_name", MODEL_ORDER), "segment_column",
                     "accuracy", "-complaints"],
    "confusion_matrix": [("feature_set", FEATURE_SET_ORDER), ("model_name", MODEL_ORDER),
                         ("actual_resolution_bucket", BUCKET_ORDER), ("predicted_resolution_bucket", BUCKET_ORDER)],
}


def sort_table(name: str, df: DataFrame) -> DataFrame:
    keys = SORT_KEYS.get(name) or RANKED_KEYS.get(name)
    if not keys:
        return df
    columns = []
    for key in keys:
        if isinstance(key, tuple):
            columns += order_by_rank(*key)
        else:
            columns.append(F.desc_nulls_last(key[1:]) if key.startswith("-") else F.asc_nulls_last(key))
    return df.orderBy(*columns)


def publish_stage(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    return publish({name: sort_table(name, df) for name, df in tables.items()}, folder)


def analytic_stage(spark: SparkSession, raw_path: str, out: str, scope: Scope = DEFAULT_SCOPE, buckets: int = BUCKETS) -> DataFrame:
    """Raw year folders, every year from the scope's start, to the analytic table, which lies in buckets of its key."""
    raw = read_years(spark, raw_path, list(range(int(scope.start[:4]), scope.partial_year + 1)))
    return read_table(spark, write_bucketed(frames.build_analytic(raw, scope), f"{out}/analytic", buckets=buckets)).drop(HAS_KEY)


def taxonomy_stage(analytic: DataFrame, closure_texts: DataFrame | None, rules=SUBTYPE_RULES,
                   mismatches=MISMATCH_RULES, outcomes=OUTCOME_RULES, cluster: bool = True,
                   profiles_path: str | None = None) -> DataFrame:
    """Text labels per request; closure texts come from their own table, by key.

    Profiles of the clusters of unmatched texts are published at ``profiles_path``.
    """
    base = taxonomy.add_normalized_text(taxonomy.clean_taxonomy_input(analytic))
    labelled = taxonomy.flag_label_mismatches(taxonomy.assign_subtypes(base, rules), mismatches)
    if cluster:
        assignments, profiles = ngrams.residual_clusters(labelled)
        if profiles_path is not None:
            write_table(profiles, profiles_path)
        labelled = ngrams.attach_clusters(labelled, assignments)
    else:
        labelled = labelled.withColumns({
            "residual_cluster": F.lit(None).cast("bigint"), "residual_cluster_label": F.lit(None).cast("string")})
    if closure_texts is None:
        empty = {name: F.lit(None).cast(kind) for name, kind in (
            ("resolution_outcome_group", "string"), ("resolution_outcome_confidence", "string"),
            ("resolution_text_length", "bigint"))}
        labelled = taxonomy.fill_missing_outcomes(labelled.withColumns(empty))
    else:
        assert_unique(closure_texts, "unique_key")
        labelled = taxonomy.attach_outcomes(labelled, closure_texts, outcomes)
    return labelled.select(*TAXONOMY_COLUMNS)


def operations_stage(enriched: DataFrame, scope: Scope = DEFAULT_SCOPE) -> Tables:
    return {
        "agency_metrics": scorecards.agency_scorecard(enriched),
        "complaint_type_metrics": scorecards.type_scorecard(enriched),
        "agency_issue_metrics": scorecards.agency_issue_bottlenecks(enriched),
        "operations_monthly": scorecards.operations_monthly(enriched, scope),
        "community_board_operations": scorecards.board_operations(enriched),
    }


def geography_stage(enriched: DataFrame, areas: DataFrame, size: float = GRID_SIZE_DEGREES,
                    box: Box = DEFAULT_BOX, out: str | None = None) -> Tables:
    """Tables of areas, boards and cells; with ``out`` the cells' months are written first, and read for the persistence."""
    monthly = geography.grid_monthly(enriched, size, box)
    if out is not None:
        monthly = read_table(enriched.sparkSession, write_table(monthly, f"{out}/grid_monthly_cells"))
    return {
        "zcta_metrics": geography.area_metrics(enriched, areas),
        "community_board_metrics": geography.board_metrics(enriched),
        "community_board_monthly": geography.board_monthly(enriched),
        "grid_monthly": monthly,
        "grid_persistence": geography.grid_persistence(monthly),
    }


def equity_stage(enriched: DataFrame, demographics: DataFrame) -> Tables:
    frame = equity.equity_frame(enriched, demographics)
    return {
        "zcta_fairness_metrics": equity.area_equity(frame, demographics),
        "zcta_fairness_stratified": equity.matched_gaps(frame, demographics),
        "zcta_fairness_monthly": equity.equity_monthly(frame, demographics),
        "community_board_fairness_sensitivity": equity.board_sensitivity(frame),
        "fairness_model_results": equity.adjusted_models(frame),
    }


def forecast_stage(enriched: DataFrame, scope: Scope = DEFAULT_SCOPE, train_size: int = 350_000,
                   tree_rounds: int = 200, min_slice_rows: int = 1000,
                   min_count: int = 100, min_leaf: int = 200) -> Tables:
    """Baseline, logistic and tree models for both feature sets, with their evaluation; ``train_size`` bounds the fit of the trees alone."""
    train, test = forecast.split_by_year(forecast.model_frame(enriched, scope), scope)
    classes, rows = forecast.train_classes(train), train.count()
    baseline = forecast.majority_predictions(train, test)
    metrics = [forecast.classification_report(baseline, classes, MODEL_ORDER[0], "shared", rows)]
    predictions, importance, confusion = [], [], []
    for name, features in FEATURE_SETS.items():
        logistic, weights = forecast.logistic_forecast(train, test, features, name, min_count=min_count)
        trees = forecast.tree_forecast(train, test, features, name, rounds=tree_rounds, min_leaf=min_leaf, train_size=train_size)
        predictions.append(logistic)
        importance.append(weights)
        for model, frame, fitted in ((MODEL_ORDER[1], logistic, rows), (MODEL_ORDER[2], trees, min(rows, train_size))):
            metrics.append(forecast.classification_report(frame, classes, model, name, fitted))
            confusion.append(forecast.confusion_matrix(frame, classes, model, name))
    scored = forecast.union_all(predictions)
    return {
        "model_metrics": forecast.union_all(metrics),
        "predictions": scored,
        "feature_importance": forecast.union_all(importance),
        "error_slices": forecast.error_slices(scored, min_rows=min_slice_rows),
        "confusion_matrix": forecast.union_all(confusion),
    }


def exploratory_summaries(analytic: DataFrame, scope: Scope = DEFAULT_SCOPE) -> Tables:
    described = analytic.withColumn("descriptor", F.coalesce("descriptor", F.lit("Unknown")))
    return {
        "quality": summaries.quality_summary(analytic),
        "monthly": summaries.monthly_counts(analytic, scope),
        "monthly_by_type": summaries.monthly_by_type(analytic),
        "top_complaint_types": top_counts(analytic, "complaint_type", 12),
        "seasonal": summaries.seasonal_counts(analytic, scope),
        "hourly": count_by(analytic, "created_hour"),
        "weekday_hour": count_by(analytic, "created_weekday", "created_hour"),
        "borough_counts": count_by(analytic, "borough"),
        "borough_mix": summaries.borough_mix(analytic),
        "resolution_bucket_counts": summaries.bucket_counts(analytic),
        "descriptor_counts": top_counts(described, "descriptor", 15),
        "sample_rows": summaries.sample_rows(analytic),
    }


def text_summaries(labelled: DataFrame, boards: DataFrame, agencies: DataFrame) -> Tables:
    return {
        "overall": summaries.text_overall(labelled),
        "issue_families": top_counts(labelled, "issue_family", 15),
        "modeled_subtypes": top_counts(labelled.where("subtype_modeled_flag"), "issue_subtype", 15),
        "subtype_source": count_by(labelled, "subtype_source"),
        "outcome_groups": count_by(labelled, "resolution_outcome_group"),
        "outcome_confidence": count_by(labelled, "resolution_outcome_confidence"),
        "complaint_type_coverage": summaries.type_coverage(labelled),
        "residual_counts": summaries.residual_counts(labelled),
        "outcome_by_complaint_type": count_by(labelled, "resolution_outcome_group", "complaint_type"),
        "outcome_by_agency": count_by(labelled, "resolution_outcome_group", "agency"),
        "board_top_subtypes": summaries.leader_counts(boards),
        "agency_top_subtypes": agencies.select("agency", "complaints", "top_modeled_subtype"),
    }


def geo_summaries(analytic: DataFrame, labelled: DataFrame, monthly_grid: DataFrame,
                  size: float = GRID_SIZE_DEGREES, box: Box = DEFAULT_BOX) -> Tables:
    flag = valid_coordinate(F.col("latitude"), F.col("longitude"), box)
    located = analytic.withColumn("valid_coordinate_flag", flag)
    labels = labelled.select("unique_key", "issue_subtype", "subtype_modeled_flag")
    joined = located.join(labels, "unique_key", "left")
    modeled = joined.where(F.col("subtype_modeled_flag") & (F.col("issue_subtype") != "not_modeled"))
    return {
        "borough_coverage": geography.borough_coverage(located),
        "hotspot_monthly": geography.hotspot_monthly(monthly_grid),
        "complaint_hotspots": geography.hotspots_by_category(located, "complaint_type", size=size, box=box),
        "subtype_hotspots": geography.hotspots_by_category(modeled, "issue_subtype", size=size, box=box),
    }


def serving_projections(spark: SparkSession, analytic_path: str, taxonomy_path: str, out: str) -> list[str]:
    """Narrow tables for serving."""
    return [
        write_projection(spark, analytic_path, CORE_PROJECTION, f"{out}/analytic_core"),
        write_projection(spark, analytic_path, GEO_PROJECTION, f"{out}/analytic_geo"),
        write_projection(spark, taxonomy_path, TAXONOMY_PROJECTION, f"{out}/issue_subtypes"),
    ]


def run(spark: SparkSession, raw_path: str, out: str, areas: DataFrame, demographics: DataFrame,
        closure_texts: DataFrame | None = None, scope: Scope = DEFAULT_SCOPE, buckets: int = BUCKETS, **forecast_options) -> dict[str, str]:
    """All stages in order; returns the paths of the published tables.

    The analytic table and its labels lie in ``buckets`` of the key, so their join and its checks shuffle nothing.
    """
    analytic = analytic_stage(spark, raw_path, out, scope, buckets)
    labels = taxonomy_stage(analytic, closure_texts, profiles_path=f"{out}/residual_cluster_profiles")
    sides = [f"{out}/analytic", write_bucketed(labels, f"{out}/issue_subtypes", buckets=buckets)]
    labelled = read_table(spark, sides[1]).drop(HAS_KEY)
    for side in sides:
        assert_unique(read_bucketed(spark, side)[0], "unique_key")  # the join is one to one
    write_table(frames.enrich_bucketed(spark, *sides), f"{out}/enriched")
    enriched = read_table(spark, f"{out}/enriched")
    paths = publish_stage(operations_stage(enriched, scope), out)
    paths |= publish_stage(geography_stage(enriched, areas, out=out), out)
    paths |= publish_stage(equity_stage(enriched, demographics), out)
    paths |= publish_stage(forecast_stage(enriched, scope, **forecast_options), out)
    paths |= publish_stage(exploratory_summaries(analytic, scope), f"{out}/summaries")
    boards, agencies, grid = (read_table(spark, paths[name]) for name in
                              ("community_board_metrics", "agency_metrics", "grid_monthly"))
    paths |= publish_stage(text_summaries(labelled, boards, agencies), f"{out}/summaries")
    paths |= publish_stage(geo_summaries(analytic, labelled, grid), f"{out}/summaries")
    serving_projections(spark, f"{out}/analytic", f"{out}/issue_subtypes", f"{out}/serving")
    return paths
