"""Calendar features, lifecycle flags and resolution intervals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqlens.contracts import BUCKET_EDGES, BUCKET_ORDER, SEASON_ORDER, Box, Scope


def month_start(ts: Column) -> Column:
    return F.date_trunc("MONTH", ts).cast("timestamp_ntz")


def season_of_month(month: Column) -> Column:
    """December to February is winter, and so on in blocks of three months."""
    index = F.floor((month % 12) / 3).cast("int") + 1
    return F.element_at(F.array(*[F.lit(name) for name in SEASON_ORDER]), index)


def calendar_features(ts: Column) -> dict[str, Column]:
    return {
        "created_year": F.year(ts),
        "created_month": F.month(ts),
        "created_month_start": month_start(ts),
        "created_weekday": F.date_format(ts, "EEEE"),
        "created_hour": F.hour(ts),
        "created_season": season_of_month(F.month(ts)),
    }


def hours_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6) / F.lit(3600.0)


def duration_bucket(days: Column) -> Column:
    """Right-closed buckets: exactly one day is still ``<1 day``; null stays null."""
    bucket = F.when(days <= BUCKET_EDGES[0], BUCKET_ORDER[0])
    for edge, label in zip(BUCKET_EDGES[1:], BUCKET_ORDER[1:]):
        bucket = bucket.when(days <= edge, label)
    return bucket.when(days > BUCKET_EDGES[-1], BUCKET_ORDER[-1])


def valid_coordinate(latitude: Column, longitude: Column, box: Box) -> Column:
    inside = latitude.between(box.lat_min, box.lat_max) & longitude.between(box.lon_min, box.lon_max)
    return F.coalesce(inside, F.lit(False))


def month_label(month: Column, pattern: str = "yyyy-MM") -> Column:
    return F.date_format(month, pattern)


def year_label(year: Column, scope: Scope, partial_suffix: str = " YTD") -> Column:
    text = year.cast("string")
    return F.when(year == scope.partial_year, F.concat(text, F.lit(partial_suffix))).otherwise(text)


def year_type(year: Column, scope: Scope) -> Column:
    return F.when(year == scope.partial_year, "YTD").otherwise("full_or_aligned")
