"""Area, board and grid metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reqlens.contracts import BOARD_KEYS, DEFAULT_BOX, GRID_SIZE_DEGREES, Box
from reqlens.functions.lifecycle import month_label
from reqlens.functions.measures import per_10k, rate_of
from reqlens.operators.joins import attach, join_with_zero_fill, members
from reqlens.operators.order_statistics import leading_labels, small_quantile, summarize, tally
from reqlens.operators.ranking import count_by, first_per_group, top_counts
from reqlens.operators.scorecards import DURATION_QUANTILES, resolved_days


def area_metrics(df: DataFrame, areas: DataFrame) -> DataFrame:
    """Metrics of every reference area; areas without requests count zero."""
    flags = {"unresolved_complaints": F.col("unresolved_flag"), "geocoded_complaints": F.col("valid_coordinate_flag")}
    tallied = tally(df, {"zcta": F.col("incident_zip_clean")}, flags, resolved_days())
    metrics = summarize(tallied, ["zcta"], "complaints", list(flags), DURATION_QUANTILES).withColumns({
        "unresolved_share": F.col("unresolved_complaints") / F.col("complaints"),
        "geocoded_share": F.col("geocoded_complaints") / F.col("complaints"),
    })
    counts = ["complaints", *flags]
    joined = join_with_zero_fill(areas, metrics, "zcta", counts)
    return joined.withColumns({
        "complaints_per_10k": per_10k(F.col("complaints"), F.col("population")),
        "unresolved_per_10k": per_10k(F.col("unresolved_complaints"), F.col("population")),
    })


def board_metrics(df: DataFrame) -> DataFrame:
    """Metrics per board row. Quantiles are keyed by the board alone; the null board has none."""
    flags = {
        "unresolved_complaints": F.col("unresolved_flag"),
        "geocoded_complaints": F.col("valid_coordinate_flag"),
        "modeled_subtype_complaints": F.col("subtype_modeled_flag"),
        "mismatch_flagged_complaints": F.col("potential_label_mismatch_flag"),
    }
    leaders = {"top_complaint_type": "complaint_type", "top_issue_subtype": "issue_subtype"}
    tallied = tally(df, BOARD_KEYS, flags, resolved_days(), labels={name: F.col(name) for name in leaders.values()})
    summary = attach(summarize(tallied, BOARD_KEYS, "complaints", list(flags), {}),
                     leading_labels(tallied, BOARD_KEYS, leaders), BOARD_KEYS).fillna("Unknown", list(leaders))
    quantiles = summarize(tallied, ["community_board"], "rows", [], DURATION_QUANTILES).drop("rows")
    rank = F.dense_rank().over(
        Window.partitionBy("community_board_borough").orderBy(F.desc("complaints"))).cast("double")
    return summary.join(quantiles, "community_board", "left").withColumns({
        "unresolved_share": F.col("unresolved_complaints") / F.col("complaints"),
        "geocoded_share": F.col("geocoded_complaints") / F.col("complaints"),
        "modeled_subtype_share": F.col("modeled_subtype_complaints") / F.col("complaints"),
        "mismatch_flag_share": F.col("mismatch_flagged_complaints") / F.col("complaints"),
        "borough_complaint_rank": F.when(F.col("community_board_borough").isNotNull(), rank),
    })


def board_monthly(df: DataFrame) -> DataFrame:
    return df.groupBy("created_month_start", "created_year", "community_board", "community_board_borough").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.count_if("unresolved_flag").alias("unresolved_complaints"),
        F.count_if("potential_label_mismatch_flag").alias("mismatch_flagged_complaints"),
    ).withColumns({
        "unresolved_share": F.col("unresolved_complaints") / F.col("complaints"),
        "mismatch_flag_share": F.col("mismatch_flagged_complaints") / F.col("complaints"),
    })


def _bin(coordinate: str, low: float, size: float) -> Column:
    return F.floor((F.col(coordinate) - F.lit(low)) / F.lit(size)).cast("int")


def grid_bounds(size: float = GRID_SIZE_DEGREES, box: Box = DEFAULT_BOX) -> dict[str, Column]:
    lon = F.lit(box.lon_min) + F.col("grid_lon_bin") * F.lit(size)
    lat = F.lit(box.lat_min) + F.col("grid_lat_bin") * F.lit(size)
    return {
        "grid_lon_min": lon, "grid_lat_min": lat,
        "grid_lon_max": lon + F.lit(size), "grid_lat_max": lat + F.lit(size),
    }


def grid_bins(df: DataFrame, size: float = GRID_SIZE_DEGREES, box: Box = DEFAULT_BOX) -> DataFrame:
    """Cell numbers of every request with a valid coordinate."""
    binned = df.where("valid_coordinate_flag").withColumns({
        "grid_lon_bin": _bin("longitude", box.lon_min, size),
        "grid_lat_bin": _bin("latitude", box.lat_min, size),
    })
    return binned.withColumn("grid_id", F.concat_ws(":", F.col("grid_lon_bin"), F.col("grid_lat_bin")))


def assign_grid_bins(df: DataFrame, size: float = GRID_SIZE_DEGREES, box: Box = DEFAULT_BOX) -> DataFrame:
    return grid_bins(df, size, box).withColumns(grid_bounds(size, box))


def grid_monthly(df: DataFrame, size: float = GRID_SIZE_DEGREES, box: Box = DEFAULT_BOX) -> DataFrame:
    """Requests per month and cell; bounds follow from the cell, so they stay out of the keys."""
    monthly = grid_bins(df, size, box).groupBy("created_month_start", "grid_id", "grid_lon_bin", "grid_lat_bin").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.count_if("unresolved_flag").alias("unresolved_complaints"),
    )
    return monthly.withColumns(grid_bounds(size, box)).withColumn(
        "unresolved_share", F.col("unresolved_complaints") / F.col("complaints"))


def flag_hotspots(monthly: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Cells at or above the month's quantile over active cells."""
    thresholds = monthly.groupBy("created_month_start").agg(
        small_quantile("complaints", quantile).alias("hotspot_threshold"))
    return monthly.join(thresholds, "created_month_start").withColumn(
        "is_hotspot", F.col("complaints") >= F.col("hotspot_threshold"))


def cell_polygon() -> Column:
    corners = ["grid_lon_max", "grid_lat_min", "grid_lon_max", "grid_lat_max", "grid_lon_min", "grid_lat_max",
               "grid_lon_min", "grid_lat_min", "grid_lon_max", "grid_lat_min"]
    return F.format_string(
        "POLYGON ((%s %s, %s %s, %s %s, %s %s, %s %s))", *[F.col(name).cast("string") for name in corners])


def with_geometry(cells: DataFrame) -> DataFrame:
    return cells.withColumns({
        "geometry_wkt": cell_polygon(),
        "longitude": (F.col("grid_lon_min") + F.col("grid_lon_max")) / 2,
        "latitude": (F.col("grid_lat_min") + F.col("grid_lat_max")) / 2,
    })


def grid_persistence(monthly: DataFrame, quantile: float = 0.9) -> DataFrame:
    """How often each cell is a hotspot over the months in which it is active."""
    cells = flag_hotspots(monthly, quantile).groupBy(
        "grid_id", "grid_lon_bin", "grid_lat_bin", "grid_lon_min", "grid_lon_max", "grid_lat_min", "grid_lat_max",
    ).agg(
        F.sum("complaints").alias("total_complaints"),
        F.sum("unresolved_complaints").alias("total_unresolved_complaints"),
        F.count_if("is_hotspot").alias("hotspot_months"),
        F.count("created_month_start").alias("active_months"),
    )
    return with_geometry(cells.withColumns({
        "hotspot_month_share": F.col("hotspot_months") / F.col("active_months"),
        "unresolved_share": F.col("total_unresolved_complaints") / F.col("total_complaints"),
    }))


def hotspot_monthly(monthly: DataFrame, quantile: float = 0.9) -> DataFrame:
    return flag_hotspots(monthly, quantile).groupBy("created_month_start").agg(
        F.count_if("is_hotspot").alias("hotspot_cells"),
        F.sum(F.when(F.col("is_hotspot"), F.col("complaints")).otherwise(0)).alias("hotspot_complaints"),
        F.sum("complaints").alias("total_complaints"),
    ).withColumns({
        "hotspot_complaint_share": F.col("hotspot_complaints") / F.col("total_complaints"),
        "month_label": month_label(F.col("created_month_start")),
    })


def hotspots_by_category(df: DataFrame, category: str, categories: int = 6, cells: int = 3,
                         size: float = GRID_SIZE_DEGREES, box: Box = DEFAULT_BOX) -> DataFrame:
    """Busiest cells of the most frequent categories, with up to three borough names."""
    placed = grid_bins(df, size, box)
    leading = members(placed, top_counts(placed, category, categories), category)
    names = F.array_join(F.slice(F.sort_array(F.collect_set("borough")), 1, 3), ", ")
    summary = leading.groupBy(category, "grid_id").agg(
        F.count(F.lit(1)).alias("complaints"), names.alias("boroughs"))
    return first_per_group(summary, [category], cells, F.desc("complaints"), F.asc("grid_id"))


def density_bins(df: DataFrame, size: float, box: Box = DEFAULT_BOX) -> DataFrame:
    """Requests per square cell of a chosen size."""
    return count_by(grid_bins(df, size, box), "grid_id", "grid_lon_bin", "grid_lat_bin")


def borough_coverage(df: DataFrame) -> DataFrame:
    return df.where(F.col("borough").isNotNull()).groupBy("borough").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.count_if("valid_coordinate_flag").alias("geocoded_complaints"),
    ).withColumn("geocoded_share", F.col("geocoded_complaints") / F.col("complaints"))


def borough_quality(df: DataFrame) -> DataFrame:
    return df.where(F.col("borough").isNotNull()).groupBy("borough").agg(
        F.count(F.lit(1)).alias("complaints"),
        rate_of(F.col("valid_coordinate_flag")).alias("geocoded_rate"),
        rate_of(F.col("unresolved_flag")).alias("unresolved_rate"),
        rate_of(F.col("subtype_modeled_flag")).alias("modeled_subtype_rate"),
    )


def map_points(metrics: DataFrame, geometry: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Metrics joined to the areas that have a boundary."""
    return metrics.select(key, *columns).join(geometry.where(F.col("geometry_wkt").isNotNull()), key, "inner")
