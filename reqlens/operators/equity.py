"""Area demographics: row-weighted quintiles, matched gaps, adjusted models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reqlens.contracts import BOARD_KEYS, DEMOGRAPHIC_COLUMNS, ISSUE_LEVELS, QUINTILES
from reqlens.functions.cleaning import zip_code
from reqlens.functions.measures import per_10k
from reqlens.operators import collapsed
from reqlens.operators.filters import matched_areas
from reqlens.operators.frames import add_board_fields
from reqlens.operators.joins import attach
from reqlens.operators.order_statistics import key_order, smallest_keys
from reqlens.operators.scorecards import EQUITY_COUNTS, against_benchmark, group_summary, labelled_summary
from reqlens.session import cut_lineage

PARTS = 5


def quintile_labels(word: str) -> list[str]:
    return [f"Q1 lowest {word}", "Q2", "Q3", "Q4", f"Q5 highest {word}"]


def equity_frame(enriched: DataFrame, demographics: DataFrame) -> DataFrame:
    """Requests with the demographics of their area (many-to-one); board fields follow the filled borough."""
    filled = enriched.withColumns({
        "borough": F.coalesce(F.upper("borough"), F.lit("Unknown")),
        "descriptor": F.coalesce("descriptor", F.lit("Unknown")),
        "zcta": zip_code("incident_zip"),
    })
    return add_board_fields(filled).join(demographics.drop("zcta_name", "acs_name"), "zcta", "left").withColumn(
        "zcta_demographic_match_flag", F.col("median_household_income").isNotNull())


def _area_positions(df: DataFrame, quintiles: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rank range of every area for every measure: (quintile, zcta, value, n, start, end, ranked).

    Requests are ranked by (value, area, key). All requests of an area share the value, so the
    ranges follow from counts per area; no window sees requests.
    """
    sources = sorted({source for source, _ in quintiles.values()})
    areas = df.where(F.col("zcta").isNotNull()).groupBy("zcta").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(source).alias(source) for source in sources])
    measured = areas.select("zcta", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("quintile"), F.col(source).cast("double").alias("value"))
        for name, (source, _) in quintiles.items()])).alias("m")).select("zcta", "n", "m.*")
    measured = measured.where(F.col("value").isNotNull())
    whole = Window.partitionBy("quintile")
    upto = whole.orderBy("value", "zcta").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = measured.withColumns({
        "end": F.sum("n").over(upto),
        "ranked": F.sum("n").over(whole),
        "distinct_values": F.size(F.collect_set("value").over(whole)),
    })
    return ranges.where(F.col("distinct_values") >= PARTS).withColumn("start", F.col("end") - F.col("n"))


def _last_rank(part: int) -> Column:
    """Last rank inside the first ``part`` fifths."""
    return F.floor((F.col("ranked") - 1) * part / PARTS) + 1


def area_quintiles(df: DataFrame, quintiles: Mapping[str, tuple[str, str]] = QUINTILES) -> DataFrame:
    """Quintile of the first ranked request of each area, one column per measure."""
    ranges = _area_positions(df, quintiles)
    number = sum((F.when(_last_rank(part) <= F.col("start"), 1).otherwise(0) for part in range(1, PARTS)), F.lit(1))
    return ranges.groupBy("zcta").agg(*[
        F.max(F.when(F.col("quintile") == name, _label(number, word))).alias(name)
        for name, (_, word) in quintiles.items()])


def _label(number: Column, word: str) -> Column:
    return F.get(F.array(*[F.lit(label) for label in quintile_labels(word)]), number - 1)


def quintile_table(df: DataFrame, quintiles: Mapping[str, tuple[str, str]] = QUINTILES,
                   key: str = "unique_key") -> DataFrame:
    """Per area and measure: the quintile of its first request, and the keys after which it rises.

    At most four areas per measure hold a boundary, so almost every list of keys is empty.
    """
    ranges = cut_lineage(_area_positions(df, quintiles))  # a row per area and measure, read several times below
    boundaries = ranges.select(
        "quintile", "zcta", "start", "n",
        F.explode(F.array(*[_last_rank(part) for part in range(1, PARTS)])).alias("last"))
    inside = boundaries.where((F.col("start") < F.col("last")) & (F.col("last") < F.col("start") + F.col("n"))).select(
        "quintile", "zcta", (F.col("last") - F.col("start")).alias("position"))
    keys = smallest_keys(df, "zcta", key, inside.select("zcta", "position").distinct())
    cuts = inside.join(keys, ["zcta", "position"]).groupBy("zcta", "quintile").agg(
        F.collect_list("cut").alias("cuts"))
    first = sum((F.when(_last_rank(part) <= F.col("start"), 1).otherwise(0) for part in range(1, PARTS)), F.lit(1))
    table = ranges.select("zcta", "quintile", first.alias("first")).join(cuts, ["zcta", "quintile"], "left")
    return table.groupBy("zcta").agg(*[
        F.max(F.when(F.col("quintile") == name, F.struct("first", "cuts"))).alias(f"_{name}") for name in quintiles])


def label_quintiles(rows: DataFrame, table: DataFrame, quintiles: Mapping[str, tuple[str, str]] = QUINTILES,
                    key: str = "unique_key") -> DataFrame:
    """Quintile of each row: a comparison of its key with the boundaries of its area."""
    place = key_order(key)

    def number(name: str) -> Column:
        passed = F.filter(F.col(f"_{name}.cuts"), lambda cut: place > cut)
        return F.col(f"_{name}.first") + F.coalesce(F.nullif(F.size(passed), F.lit(-1)), F.lit(0))

    return rows.join(table, "zcta", "left").withColumns({
        name: _label(number(name).cast("int"), word) for name, (_, word) in quintiles.items()
    }).drop(*[f"_{name}" for name in quintiles])


def request_quintiles(df: DataFrame, quintiles: Mapping[str, tuple[str, str]] = QUINTILES,
                      key: str = "unique_key") -> DataFrame:
    """Quintile of every request, volume-weighted: an area may straddle a boundary."""
    return label_quintiles(df, quintile_table(df, quintiles, key), quintiles, key)


def area_attributes(df: DataFrame, demographics: DataFrame) -> DataFrame:
    """Demographics and quintiles, one row per area."""
    return demographics.select("zcta", *DEMOGRAPHIC_COLUMNS).join(area_quintiles(df), "zcta", "left")


def area_equity(df: DataFrame, demographics: DataFrame) -> DataFrame:
    summary = labelled_summary(matched_areas(df), ["zcta"], {
        "top_borough": "borough",
        "top_agency": "agency",
        "top_complaint_type": "complaint_type",
        "top_issue_family": "issue_family",
    }, {"borough_count": "borough"}, EQUITY_COUNTS)
    return summary.join(area_attributes(df, demographics), "zcta", "left").withColumns({
        "complaints_per_10k": per_10k(F.col("complaints"), F.col("population")),
        "unresolved_per_10k": per_10k(F.col("unresolved_complaints"), F.col("population")),
    })


def matched_gaps(df: DataFrame, demographics: DataFrame, levels: Sequence[str] = ISSUE_LEVELS) -> DataFrame:
    """Every area inside every (issue, agency) against that benchmark."""
    cells = against_benchmark(
        matched_areas(df), ["issue_level", "zcta", "issue_value", "agency"], ["issue_level", "issue_value", "agency"],
        EQUITY_COUNTS, "benchmark", "cell_volume_share_of_benchmark", levels)
    return cells.join(area_attributes(df, demographics), "zcta", "left")


def equity_monthly(df: DataFrame, demographics: DataFrame) -> DataFrame:
    monthly = group_summary(matched_areas(df), ["created_month_start", "created_year", "zcta"], EQUITY_COUNTS)
    return monthly.join(area_attributes(df, demographics), "zcta", "left").withColumn(
        "complaints_per_10k", per_10k(F.col("complaints"), F.col("population")))


def board_sensitivity(df: DataFrame) -> DataFrame:
    return labelled_summary(df, BOARD_KEYS, {
        "top_agency": "agency",
        "top_complaint_type": "complaint_type",
        "top_issue_family": "issue_family",
    }, counts=EQUITY_COUNTS)


# Adjusted models -------------------------------------------------------------

CONTROL_FEATURES = ["complaint_type", "agency", "borough", "created_year", "created_season"]
RESULT_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("coefficient", T.DoubleType()),
    T.StructField("metric", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
    T.StructField("sample_rows", T.LongType()),
])


def model_rows(df: DataFrame, quintiles: DataFrame) -> DataFrame:
    """Rows of matched areas with all features known; ``quintiles`` is the written table of ``quintile_table``."""
    features = [*QUINTILES, *CONTROL_FEATURES]
    sources = [source for source, _ in QUINTILES.values()]
    columns = ["unique_key", "zcta", *CONTROL_FEATURES, "resolved_with_valid_date", "resolution_days", "unresolved_flag"]
    usable = matched_areas(df).dropna(subset=[*sources, *CONTROL_FEATURES]).select(*columns)
    return label_quintiles(usable, quintiles).dropna(subset=features)


def _duration_part() -> tuple[Column, dict[str, Column]]:
    log_days = F.log1p("resolution_days")
    return F.col("resolved_with_valid_date") & F.col("resolution_days").isNotNull(), {"total": log_days, "squares": log_days * log_days}


def _backlog_part() -> tuple[Column, dict[str, Column]]:
    return F.col("unresolved_flag").isNotNull(), {"positives": F.col("unresolved_flag").cast("int")}


def duration_design(rows: DataFrame) -> collapsed.Design:
    resolved, sums = _duration_part()
    return collapsed.collapse(rows.where(resolved), [*QUINTILES, *CONTROL_FEATURES], sums)


def model_designs(rows: DataFrame) -> dict[str, collapsed.Design]:
    """The designs of the duration and the backlog model, from one pass over the rows."""
    return collapsed.collapse_parts(rows, [*QUINTILES, *CONTROL_FEATURES], {"duration": _duration_part(), "backlog": _backlog_part()})


def adjusted_models(df: DataFrame) -> DataFrame:
    """Demographic coefficients of a duration and a backlog model, controlling for the mix.

    Both models use every row: equal feature rows are folded, and each pass of a fit is an aggregate over
    the folded rows. So the result does not depend on how the rows are spread.
    """
    spark = df.sparkSession
    demographic = list(QUINTILES)
    designs = model_designs(model_rows(df, cut_lineage(quintile_table(df))))
    duration, backlog = designs["duration"], designs["backlog"]
    coefficients, fit, count = collapsed.least_squares(duration, "total", "squares")
    rows = _coefficient_rows("log_resolution_days", _names(duration), coefficients[1:], demographic, "r2", fit, count)
    coefficients = collapsed.logistic(backlog, "positives")
    area = collapsed.area_under_curve(backlog, coefficients, "positives")
    count = backlog.rows.agg(F.coalesce(F.sum(collapsed.ROWS), F.lit(0))).first()[0]
    rows += _coefficient_rows("unresolved_log_odds", _names(backlog), coefficients[1:], demographic, "roc_auc", area, count)
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def _names(design: collapsed.Design) -> list[str]:
    return [f"{feature}_{level}" for feature, level in design.names]


def _coefficient_rows(model, names, coefficients, demographic, metric, value, count) -> list[tuple]:
    return [(model, name, float(c), metric, float(value), int(count)) for name, c in zip(names, coefficients)
            if any(token in name for token in demographic)]


def ranked_coefficients(results: DataFrame, model: str, n: int) -> DataFrame:
    chosen = results.where((F.col("model_name") == model) & F.col("feature").contains("quintile"))
    return chosen.withColumns({
        "abs_coefficient": F.abs("coefficient"),
        "feature_clean": F.replace(F.col("feature"), F.lit("_"), F.lit(" ")),
    }).orderBy(F.desc("abs_coefficient"), F.asc("feature")).limit(n)


# Rollups ---------------------------------------------------------------------


def quintile_rollup(areas: DataFrame, quintile: str) -> DataFrame:
    return areas.groupBy(F.col(quintile).alias("quintile_value")).agg(
        F.count("zcta").alias("zctas"),
        F.sum("complaints").alias("complaints"),
        F.median("complaints_per_10k").alias("median_complaints_per_10k"),
        F.median("median_resolution_days").alias("median_resolution_days"),
        F.median("unresolved_share").alias("median_unresolved_share"),
        F.median("status_backlog_share").alias("median_status_backlog_share"),
    )


def quintile_monthly(monthly: DataFrame, quintiles: Sequence[str] = tuple(QUINTILES)) -> DataFrame:
    """All quintile families stacked long, from one pass over area months."""
    stacked = monthly.unpivot(
        ["month_label", "complaints", "median_resolution_days", "unresolved_share", "status_backlog_share"],
        list(quintiles), "quintile_label", "quintile_value").where(F.col("quintile_value").isNotNull())
    return stacked.groupBy("month_label", "quintile_label", "quintile_value").agg(
        F.sum("complaints").alias("complaints"),
        F.median("median_resolution_days").alias("median_resolution_days"),
        F.median("unresolved_share").alias("unresolved_share"),
        F.median("status_backlog_share").alias("status_backlog_share"),
    )


def poverty_gap_summary(cells: DataFrame, min_rows: int = 250) -> DataFrame:
    kept = cells.where((F.col("issue_level") == "complaint_type") & (F.col("complaints") >= min_rows))
    return kept.groupBy("poverty_quintile").agg(
        F.count("zcta").alias("cells"),
        F.median("median_resolution_gap_days").alias("median_gap_days"),
        F.median("unresolved_share_gap").alias("median_unresolved_gap"),
    )


def poverty_monthly(monthly: DataFrame) -> DataFrame:
    ends = [quintile_labels("poverty")[0], quintile_labels("poverty")[-1]]
    kept = monthly.where(F.col("poverty_quintile").isin(ends))
    return kept.groupBy("created_month_start", "created_year", "poverty_quintile").agg(
        F.sum("complaints").alias("complaints"),
        F.sum("unresolved_complaints").alias("unresolved_complaints"),
    ).withColumn("unresolved_share", F.col("unresolved_complaints") / F.col("complaints"))
