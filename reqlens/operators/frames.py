"""Row-level tables: the analytic table and its enriched form. Narrow transformations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reqlens.contracts import (
    DEFAULT_BOX, DEFAULT_SCOPE, RAW_COLUMNS, RENAMED_COLUMNS, Box, Scope)
from reqlens.functions import cleaning as C
from reqlens.functions import lifecycle as L
from reqlens.sources.bucketed import read_bucketed


def clean_requests(raw: DataFrame) -> DataFrame:
    """Domain standardisation of the raw string columns."""
    df = raw.select(*[F.col(name).alias(RENAMED_COLUMNS.get(name, name)) for name in RAW_COLUMNS])
    plain = ("unique_key", "additional_details", "incident_zip", "city", "community_board")
    # A projection of its own: the expressions below name each text several times.
    df = df.withColumns({name: C.strip_blanks(name) for name in (
        *plain, "borough", "status", "agency", "agency_name", "complaint_type", "descriptor")})
    df = df.withColumn("status", C.known_string("status", ("Unspecified",)))
    return df.withColumns({
        **{name: C.known_string(name) for name in plain},
        "borough": F.upper(C.known_string("borough", ("Unspecified",))),
        "status": F.coalesce(C.title_case("status"), F.lit("Unknown")),
        "agency": F.coalesce(F.upper(C.known_string("agency")), F.lit("UNKNOWN")),
        "agency_name": F.coalesce(C.known_string("agency_name"), F.lit("Unknown Agency")),
        "complaint_type": F.coalesce(C.known_string("complaint_type"), F.lit("Unknown")),
        "descriptor": F.coalesce(C.known_string("descriptor"), F.lit("Unknown")),
        "council_district": C.to_long("council_district"),
        "latitude": C.to_double("latitude"),
        "longitude": C.to_double("longitude"),
        **{name: C.to_timestamp_lenient(name) if df.schema[name].dataType == T.StringType()
           else F.col(name).cast("timestamp_ntz")
           for name in ("created_date", "closed_date", "resolution_action_updated_date")},
    })


def in_scope(df: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """Created on or after the start; a missing creation date is out of scope."""
    return df.where(F.col("created_date") >= F.lit(scope.start).cast("timestamp_ntz"))


def add_lifecycle(df: DataFrame) -> DataFrame:
    """Calendar features, quality flags, resolution interval and bucket."""
    created, closed = F.col("created_date"), F.col("closed_date")
    df = df.withColumns({
        **L.calendar_features(created),
        "is_closed_status": F.col("status").eqNullSafe("Closed"),
        "has_closed_date": closed.isNotNull(),
        "missing_coordinates_flag": F.col("latitude").isNull() | F.col("longitude").isNull(),
        "missing_borough_flag": F.col("borough").isNull(),
        "_hours": L.hours_between(created, closed),
    })
    negative = F.coalesce(F.col("_hours") < 0, F.lit(False))
    hours = F.when(F.col("_hours") >= 0, F.col("_hours"))
    return df.withColumns({
        "closed_status_missing_date_flag": F.col("is_closed_status") & ~F.col("has_closed_date"),
        "nonclosed_status_has_date_flag": ~F.col("is_closed_status") & F.col("has_closed_date"),
        "negative_resolution_flag": negative,
        "resolution_hours": hours,
        "resolution_days": hours / F.lit(24.0),
        "resolved_with_valid_date": hours.isNotNull(),
        "resolution_bucket": L.duration_bucket(hours / F.lit(24.0)),
    }).drop("_hours")


def build_analytic(raw: DataFrame, scope: Scope = DEFAULT_SCOPE) -> DataFrame:
    """The cleaned table at the grain of one request."""
    return add_lifecycle(in_scope(clean_requests(raw), scope))


def add_board_fields(df: DataFrame) -> DataFrame:
    return df.withColumn("community_board", C.strip_blanks("community_board")).withColumns({
        "community_board_code": C.board_code("community_board"),
        "community_board_borough": C.board_borough("community_board", "borough"),
        "community_board_label": F.col("community_board"),
    })


# Defaults of the enriched frame after the left join to the taxonomy.
_FLAG_DEFAULTS = [
    "resolved_with_valid_date", "has_closed_date", "closed_status_missing_date_flag",
    "nonclosed_status_has_date_flag", "negative_resolution_flag", "subtype_modeled_flag",
    "potential_label_mismatch_flag",
]


def apply_defaults(df: DataFrame, box: Box = DEFAULT_BOX) -> DataFrame:
    """Null defaults and derived flags of an enriched frame; absent columns are skipped."""
    have = set(df.columns)

    def present(mapping):
        return {name: value for name, value in mapping.items() if name in have}

    df = df.withColumns(present({
        "agency": F.coalesce(F.upper("agency"), F.lit("Unknown")),
        "agency_name": F.coalesce("agency_name", F.lit("Unknown")),
        "complaint_type": F.coalesce("complaint_type", F.lit("Unknown")),
        "status": F.coalesce(C.title_case("status"), F.lit("Unknown")),
        "issue_subtype": F.coalesce("issue_subtype", F.lit("not_modeled")),
        "resolution_outcome_group": F.coalesce("resolution_outcome_group", F.lit("unknown")),
        **{name: F.coalesce(name, F.lit(False)) for name in _FLAG_DEFAULTS},
    }))
    derived = present({
        "issue_family": F.coalesce("issue_family", "complaint_type"),
        "is_closed_status": F.coalesce(F.col("is_closed_status"), F.col("status") == "Closed"),
    }) if {"complaint_type", "status"} <= have else {}
    if derived:
        df = df.withColumns(derived)
    extra = {}
    if "resolved_with_valid_date" in have:
        extra["unresolved_flag"] = ~F.col("resolved_with_valid_date")
    if "is_closed_status" in have:
        extra["status_backlog_flag"] = ~F.col("is_closed_status")
    if "incident_zip" in have:
        extra["incident_zip_clean"] = C.zip_code("incident_zip")
    if {"latitude", "longitude"} <= have:
        extra["valid_coordinate_flag"] = L.valid_coordinate(F.col("latitude"), F.col("longitude"), box)
    df = df.withColumns(extra)
    return add_board_fields(df) if {"community_board", "borough"} <= have else df


TAXONOMY_JOIN_COLUMNS = [
    "unique_key", "issue_family", "issue_subtype", "subtype_modeled_flag",
    "potential_label_mismatch_flag", "resolution_outcome_group",
]


def enrich(analytic: DataFrame, taxonomy: DataFrame, box: Box = DEFAULT_BOX) -> DataFrame:
    """Analytic rows with their taxonomy (one-to-one on the key), defaults applied."""
    joined = analytic.join(taxonomy.select(*TAXONOMY_JOIN_COLUMNS), "unique_key", "left")
    return apply_defaults(joined, box)


def enrich_bucketed(spark: SparkSession, analytic_path: str, taxonomy_path: str, box: Box = DEFAULT_BOX) -> DataFrame:
    """``enrich`` of two tables that lie bucketed by the key: nothing is shuffled.

    Requests without a key have no taxonomy, so they pass by the join and get the defaults.
    """
    keyed, keyless = read_bucketed(spark, analytic_path)
    labels, _ = read_bucketed(spark, taxonomy_path)
    kinds = {field.name: field.dataType for field in labels.schema}
    bare = keyless.withColumns({name: F.lit(None).cast(kinds[name]) for name in TAXONOMY_JOIN_COLUMNS[1:]})
    return enrich(keyed, labels, box).unionByName(apply_defaults(bare, box))


def enrich_inline(labelled: DataFrame, box: Box = DEFAULT_BOX) -> DataFrame:
    """Same result when the labels were added to the same rows: no join at all."""
    return apply_defaults(labelled, box)
