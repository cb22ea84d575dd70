"""Area reference tables: population, boundaries as text, demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reqlens.contracts import CENSUS_VARIABLES
from reqlens.functions.cleaning import to_double, zip_code
from reqlens.functions.measures import share

AREA_COLUMN = "zip code tabulation area"
# Boroughs whose requests define the areas of interest.
REQUEST_BOROUGHS = ["BRONX", "BROOKLYN", "MANHATTAN", "QUEENS", "STATEN ISLAND"]


def read_array_table(spark: SparkSession, path: str) -> DataFrame:
    """A landed JSON list of lists, first inner list the header, as an all-string table."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "cells"))
    header = rows.where("pos = 0").first()["cells"]
    cells = [F.element_at("cells", index + 1).alias(name) for index, name in enumerate(header)]
    return rows.where("pos > 0").select(*cells)


def pad_area(column: Column | str) -> Column:
    """Left-pad to five digits; longer codes stay whole."""
    value = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.when(F.length(value) < 5, F.lpad(value, 5, "0")).otherwise(value)


def population_table(rows: DataFrame) -> DataFrame:
    return rows.select(
        pad_area(AREA_COLUMN).alias("zcta"),
        F.col("NAME").alias("zcta_name"),
        to_double("B01003_001E").alias("population"),
    )


def request_areas(requests: DataFrame, boroughs: Sequence[str] = REQUEST_BOROUGHS) -> DataFrame:
    """Distinct areas seen in requests of the given boroughs."""
    inside = F.upper(F.col("borough")).isin(list(boroughs))
    areas = requests.where(inside).select(zip_code("incident_zip").alias("zcta"))
    return areas.where(F.col("zcta").isNotNull()).distinct()


def build_area_reference(areas: DataFrame, requests: DataFrame, population: DataFrame,
                         boroughs: Sequence[str] = REQUEST_BOROUGHS) -> DataFrame:
    """Areas that occur in requests, with population where it is known."""
    kept = areas.withColumn("zcta", pad_area("zcta")).join(request_areas(requests, boroughs), "zcta", "left_semi")
    return kept.join(population, "zcta", "left").withColumn(
        "population_missing_flag", F.col("population").isNull())


def sum_present(*columns: Column) -> Column:
    """Sum of the non-null columns, null when all are null."""
    total = sum((F.coalesce(column, F.lit(0.0)) for column in columns), F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def demographic_columns(rows: DataFrame, null_sentinels: bool = False) -> DataFrame:
    """Named counts and shares from the census variables.

    Census tables mark missing estimates with large negative numbers; they are kept unless
    ``null_sentinels`` is set.
    """
    def number(name: str) -> Column:
        value = to_double(CENSUS_VARIABLES[name])
        return F.when(value >= 0, value) if null_sentinels else value

    direct = [name for name in CENSUS_VARIABLES if not name.endswith("_degree")]
    degrees = [number(name) for name in CENSUS_VARIABLES if name.endswith("_degree")]
    named = rows.select(
        pad_area(AREA_COLUMN).alias("zcta"),
        F.col("NAME").alias("acs_name"),
        *[number(name).alias(name) for name in direct],
        sum_present(*degrees).alias("bachelors_or_higher_count"),
    )
    return with_shares(named)


def with_shares(df: DataFrame) -> DataFrame:
    total = F.col("race_ethnicity_total")
    return df.withColumns({
        "poverty_share": share(F.col("poverty_count"), F.col("poverty_universe")),
        "renter_share": share(F.col("renter_occupied_units"), F.col("occupied_housing_units")),
        "nonwhite_share": share(total - F.col("non_hispanic_white_alone"), total),
        "bachelors_or_higher_share": share(F.col("bachelors_or_higher_count"), F.col("education_total_25_plus")),
    })


def build_area_demographics(reference: DataFrame, demographics: DataFrame) -> DataFrame:
    base = reference.select("zcta", "zcta_name", "population")
    return base.join(demographics, "zcta", "left").withColumns({
        "acs_missing_flag": F.col("median_household_income").isNull(),
        "population_gap_flag": F.col("population").isNull(),
    })
