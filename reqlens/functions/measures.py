"""Shares, modes and sort ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def share(numerator: Column, denominator: Column) -> Column:
    """Null instead of a division by zero or by null."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def per_10k(count: Column, population: Column) -> Column:
    rate = count.cast("double") / population.cast("double") * F.lit(10000.0)
    return F.when(population > 0, rate)


def rate_of(flag: Column) -> Column:
    """Share of rows whose flag is set; the mean of a boolean."""
    return F.avg(flag.cast("int"))


def first_mode(column: Column | str, default: str | None = "Unknown") -> Column:
    """Most frequent non-null value, the smallest on ties.

    The buffer holds one entry per distinct label of the group, so use it on label domains
    (agency, type, family, outcome), never on free text or keys.
    """
    mode = F.mode(column, True)
    return mode if default is None else F.coalesce(mode, F.lit(default))


def modeled_subtype() -> Column:
    """Subtype when the request belongs to a modelled family, else null."""
    modeled = F.col("subtype_modeled_flag") & (F.col("issue_subtype") != "not_modeled")
    return F.when(modeled, F.col("issue_subtype"))


def rank_in(column: Column | str, order: Sequence[str]) -> Column:
    """Position in a stated order; unseen values come after all known ones."""
    value = F.col(column) if isinstance(column, str) else column
    position = F.array_position(F.array(*[F.lit(item) for item in order]), value)
    return F.coalesce(F.nullif(position, F.lit(0)), F.lit(len(order) + 1).cast("bigint"))


def order_by_rank(column: str, order: Sequence[str]) -> list[Column]:
    """Sort keys: stated order first, then unseen values alphabetically, nulls last."""
    return [F.when(F.col(column).isNotNull(), rank_in(column, order)).asc_nulls_last(),
            F.col(column).asc_nulls_last()]
