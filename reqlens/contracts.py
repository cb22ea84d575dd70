"""Table contracts, orderings and default parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Scope:
    """The analysed period: everything from ``start``; ``partial_year`` is year-to-date."""

    start: str = "2025-01-01"
    base_year: int = 2025
    partial_year: int = 2026


@dataclass(frozen=True)
class Box:
    """Inclusive longitude/latitude box in which a coordinate counts as valid."""

    lon_min: float = -74.28
    lon_max: float = -73.68
    lat_min: float = 40.49
    lat_max: float = 40.93


DEFAULT_SCOPE = Scope()
DEFAULT_BOX = Box()
GRID_SIZE_DEGREES = 0.01

# Raw date columns and their source format.
RAW_DATE_COLUMNS = ["created_date", "closed_date", "due_date", "resolution_action_updated_date"]
RAW_DATE_FORMAT = "M/d/yyyy h:mm:ss a"
STORED_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Source columns and their names here.
RAW_COLUMNS = [
    "unique_key", "created_date", "closed_date", "resolution_action_updated_date", "agency",
    "agency_name", "problem_formerly_complaint_type", "problem_detail_formerly_descriptor",
    "additional_details", "incident_zip", "city", "status", "community_board",
    "council_district", "borough", "latitude", "longitude",
]
RENAMED_COLUMNS = {
    "problem_formerly_complaint_type": "complaint_type",
    "problem_detail_formerly_descriptor": "descriptor",
}

# Presentation orders.
WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEASON_ORDER = ["Winter", "Spring", "Summer", "Fall"]
BUCKET_ORDER = ["<1 day", "1-3 days", "3-7 days", "7-30 days", "30+ days"]
BUCKET_EDGES = [1, 3, 7, 30]
MODEL_ORDER = ["most_frequent_baseline", "multinomial_logistic", "hist_gradient_boosting"]
FEATURE_SET_ORDER = ["shared", "post_routing", "intake_only"]

ISSUE_LEVELS = ["complaint_type", "issue_family", "issue_subtype"]
BOARD_KEYS = ["community_board", "community_board_borough", "community_board_code"]

# Columns of the published tables and of their projections.
TAXONOMY_COLUMNS = [
    "unique_key", "created_date", "created_year", "agency", "borough", "community_board",
    "status", "complaint_type", "descriptor", "additional_details", "text_clean",
    "issue_family", "subtype_modeled_flag", "issue_subtype", "issue_subtype_confidence",
    "subtype_source", "subtype_match_text", "potential_label_mismatch_flag",
    "mismatch_suspected_family", "mismatch_match_text", "residual_cluster",
    "residual_cluster_label", "resolution_has_text", "resolution_outcome_group",
    "resolution_outcome_confidence", "resolution_text_length", "resolution_days",
    "resolved_with_valid_date",
]

# Columns of the narrow tables written for serving.
CORE_PROJECTION = [
    "created_date", "created_year", "created_month_start", "created_hour", "created_weekday",
    "created_season", "borough", "agency", "complaint_type", "descriptor", "status",
    "is_closed_status", "closed_status_missing_date_flag", "nonclosed_status_has_date_flag",
    "negative_resolution_flag", "resolved_with_valid_date", "resolution_days",
    "resolution_bucket",
]
GEO_PROJECTION = ["unique_key", "borough", "complaint_type", "latitude", "longitude"]
TAXONOMY_PROJECTION = [
    "unique_key", "complaint_type", "issue_family", "issue_subtype", "subtype_modeled_flag",
    "potential_label_mismatch_flag", "residual_cluster_label", "resolution_outcome_group",
    "resolution_outcome_confidence", "subtype_source", "issue_subtype_confidence", "agency",
    "borough",
]

# Columns of the area table.
DEMOGRAPHIC_COLUMNS = [
    "population", "median_household_income", "poverty_share", "renter_share",
    "nonwhite_share", "bachelors_or_higher_share", "median_gross_rent", "acs_missing_flag",
]

# Quintile column -> (demographic source column, word used in the outer labels).
QUINTILES = {
    "income_quintile": ("median_household_income", "income"),
    "poverty_quintile": ("poverty_share", "poverty"),
    "renter_quintile": ("renter_share", "renter"),
    "nonwhite_quintile": ("nonwhite_share", "nonwhite"),
    "education_quintile": ("bachelors_or_higher_share", "education"),
}
QUINTILE_COLUMNS = list(QUINTILES)

# Features of the forecasting models.
POST_ROUTING_FEATURES = [
    "complaint_type", "descriptor", "borough", "agency", "incident_zip_clean",
    "community_board", "council_district", "created_month", "created_weekday",
    "created_hour", "created_season", "issue_family", "issue_subtype",
    "subtype_modeled_flag",
]
FEATURE_SETS = {
    "post_routing": POST_ROUTING_FEATURES,
    "intake_only": [name for name in POST_ROUTING_FEATURES if name != "agency"],
}
TARGET = "resolution_bucket"

# Census variable codes of the demographic source table.
CENSUS_VARIABLES = {
    "median_household_income": "B19013_001E",
    "poverty_universe": "B17001_001E",
    "poverty_count": "B17001_002E",
    "occupied_housing_units": "B25003_001E",
    "renter_occupied_units": "B25003_003E",
    "race_ethnicity_total": "B03002_001E",
    "non_hispanic_white_alone": "B03002_003E",
    "education_total_25_plus": "B15003_001E",
    "bachelors_degree": "B15003_022E",
    "masters_degree": "B15003_023E",
    "professional_degree": "B15003_024E",
    "doctorate_degree": "B15003_025E",
    "median_gross_rent": "B25064_001E",
}

AREA_REFERENCE_SCHEMA = T.StructType([
    T.StructField("zcta", T.StringType()),
    T.StructField("zcta_name", T.StringType()),
    T.StructField("population", T.DoubleType()),
    T.StructField("population_missing_flag", T.BooleanType()),
    T.StructField("geometry_wkt", T.StringType()),
])
