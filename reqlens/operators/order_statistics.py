"""Exact order statistics by radix selection, never gathering a group into one task.

``percentile`` keeps every distinct value of a group in one buffer, and a ranking window puts
a whole group into one task. Both break when a group holds a third of a very large table.
Here pass one counts rows per group and coarse bin, combined on the map side, with the bin's least and
greatest value. The small histogram of each group tells in which bin a wanted position lies. A position at either
end of its bin, or in a bin of one value, is settled by that. Pass two counts values inside the other wanted bins only.
What crosses the network grows with groups times bins and with the values of the wanted bins, not with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from reqlens.operators.joins import all_of
from reqlens.session import cut_lineage

VALUE, ROWS, BIN, LEAST, GREATEST = "_value", "_rows", "_bin", "_least", "_greatest"
MEASURE, LABEL = "_measure", "_label"
HOUR_OF_DAY = 1.0 / 24.0
BINS_PER_DOUBLING = 16
BROADCAST_BINS = 200_000  # wanted bins (some 100 bytes each) that are broadcast; more are joined by a shuffle


@dataclass
class Tally:
    """Rows with their bin, and their counts per (keys, bin)."""

    rows: DataFrame
    keys: list[str]
    flags: list[str]
    histogram: DataFrame
    labels: DataFrame | None = None  # rows per (keys, measure, label)


def widening_bins(value: Column) -> Column:
    """Bins that widen with the value: an hour wide at a day, a day at three weeks, some 230 up to five years.

    For many small groups over a long span, where bins of one width either hold a row each or hold all short times.
    """
    return F.floor(F.signum(value) * F.log2(F.abs(value) / F.lit(HOUR_OF_DAY) + 1) * BINS_PER_DOUBLING)


def tally(df: DataFrame, keys: Mapping[str, Column] | Sequence[str], flags: Mapping[str, Column],
          value: Column | None = None, bin_width: float | None = HOUR_OF_DAY, staged: bool = False,
          labels: Mapping[str, Column] | None = None) -> Tally:
    """Rows, flagged rows, least and greatest value per (keys, bin), combined on the map side.

    ``bin_width`` bounds what pass two counts in a wanted bin: at most ``bin_width`` divided by the clock
    tick distinct values; without it, bins widen with the value. ``staged`` writes the counts once for several summaries. ``labels`` names text
    columns whose values are counted per group in the same pass, for ``leading_labels``; nulls are not
    counted. The counts are then written, as both sides read them.
    """
    named = dict(keys) if isinstance(keys, Mapping) else {key: F.col(key) for key in keys}
    measured = F.lit(None).cast("double") if value is None else value.cast("double")
    columns = {**named, **{name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}, VALUE: measured}
    labelled = {f"_label_{name}": label.cast("string") for name, label in (labels or {}).items()}
    rows = df.select(*[column.alias(name) for name, column in {**columns, **labelled}.items()])
    rows = rows.withColumn(BIN, widening_bins(F.col(VALUE)) if bin_width is None else F.floor(F.col(VALUE) / F.lit(bin_width)))
    counted = _with_labels(rows, list(labels)) if labels else rows
    by_label = [MEASURE, LABEL] if labels else []
    histogram = counted.groupBy(*named, BIN, *by_label).agg(
        F.count(F.lit(1)).alias(ROWS), *[F.count_if(F.col(name)).alias(name) for name in flags],
        F.min(VALUE).alias(LEAST), F.max(VALUE).alias(GREATEST))
    rows = rows.drop(*flags, *labelled)
    if not labels:
        return Tally(rows, list(named), list(flags), cut_lineage(histogram) if staged else histogram)
    written = cut_lineage(histogram)
    return Tally(rows, list(named), list(flags), written.where(F.col(MEASURE).isNull()).drop(*by_label),
                 written.where(F.col(MEASURE).isNotNull()).select(*named, *by_label, ROWS))


def _with_labels(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every row once for its bin (measure null) and once per label that it has (bin and value null)."""
    entries = [F.struct(F.lit(None).cast("string").alias("measure"), F.lit(None).cast("string").alias("label")),
               *[F.struct(F.lit(name).alias("measure"), F.col(f"_label_{name}").alias("label")) for name in labels]]
    spread = rows.withColumn("_entry", F.explode(F.array(*entries))).withColumns({
        MEASURE: F.col("_entry.measure"), LABEL: F.col("_entry.label")})
    spread = spread.where(F.col(MEASURE).isNull() | F.col(LABEL).isNotNull())
    return spread.withColumns({name: F.when(F.col(MEASURE).isNull(), F.col(name)) for name in (BIN, VALUE)}).drop("_entry")


def respread(tallied: Tally, keys: Sequence[str], spread: Callable[[DataFrame], DataFrame]) -> Tally:
    """The tally of rows that ``spread`` turns into several, each with its ``keys``: the counts are spread, not the rows.

    ``spread`` adds and repeats by the keys of ``tallied`` alone. The counts are written.
    """
    counts = spread(tallied.histogram).groupBy(*keys, BIN).agg(
        F.sum(ROWS).alias(ROWS), *[F.sum(name).alias(name) for name in tallied.flags], F.min(LEAST).alias(LEAST), F.max(GREATEST).alias(GREATEST))
    return Tally(spread(tallied.rows).select(*keys, VALUE, BIN), list(keys), tallied.flags, cut_lineage(counts))


def leading_labels(tallied: Tally, keys: Sequence[str], modes: Mapping[str, str],
                   distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Most frequent label (the smallest on ties) and number of distinct labels, per group of a tally.

    ``modes`` and ``distinct`` name the output column and its measure. A group without any label of a measure
    has a null mode and no distinct label; a group without labels at all is absent. No buffer holds the labels
    of a group: they are rows, and only the best so far is kept.
    """
    keys, counts = list(keys), tallied.labels
    if keys != tallied.keys:
        counts = counts.groupBy(*keys, MEASURE, LABEL).agg(F.sum(ROWS).alias(ROWS))
    best = {name: F.min(F.when(F.col(MEASURE) == measure, F.struct((-F.col(ROWS)).alias("rows"), F.col(LABEL).alias("label"))))
            for name, measure in modes.items()}
    found = counts.groupBy(*keys).agg(
        *[column.alias(name) for name, column in best.items()],
        *[F.count_if(F.col(MEASURE) == measure).alias(name) for name, measure in (distinct or {}).items()])
    return found.withColumns({name: F.col(f"{name}.label") for name in modes})


def _position(quantile: float) -> Column:
    return (F.col("_valid") - 1) * F.lit(float(quantile))


def _lower(quantile: float) -> Column:
    return F.floor(_position(quantile))


def _upper(quantile: float) -> Column:
    return F.ceil(_position(quantile))


def summarize(tallied: Tally, keys: Sequence[str], rows_as: str, sums: Sequence[str],
              quantiles: Mapping[str, float]) -> DataFrame:
    """Totals and linearly interpolated quantiles per group of a tally.

    ``keys`` may be a subset of the tally's keys: coarser groups are rolled up from the same
    counts. The histogram of the groups is written, so that pass two knows the size of what it looks for.
    """
    keys = list(keys)
    counted = [F.sum(ROWS).alias(ROWS), *[F.sum(name).alias(name) for name in sums]]
    if not quantiles:
        return tallied.histogram.groupBy(*keys).agg(*counted).withColumnRenamed(ROWS, rows_as)

    histogram = tallied.histogram
    if keys != tallied.keys:
        histogram = histogram.groupBy(*keys, BIN).agg(*counted, F.min(LEAST).alias(LEAST), F.max(GREATEST).alias(GREATEST))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(F.col(BIN).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    measured = F.when(F.col(BIN).isNotNull(), F.col(ROWS)).otherwise(F.lit(0))
    located = histogram.withColumns({
        "_end": F.sum(measured).over(upto), "_valid": F.sum(measured).over(group)})
    start = F.col("_end") - F.col(ROWS)
    edges = {f"_{side}_{name}": edge(q) for name, q in quantiles.items() for side, edge in (("lo", _lower), ("hi", _upper))}

    def within(position: Column) -> Column:
        """The bin that holds a position: its number, the place in it, the value where that is settled."""
        place = position - start
        settled = (F.when((place == 0) | (F.col(LEAST) == F.col(GREATEST)), F.col(LEAST))
                   .when(place == F.col(ROWS) - 1, F.col(GREATEST)))
        hit = F.col(BIN).isNotNull() & (start <= position) & (position < F.col("_end"))
        return F.max(F.when(hit, F.struct(F.col(BIN).alias("bin"), place.alias("place"), settled.alias("value"))))

    groups = cut_lineage(located.groupBy(*keys).agg(
        F.sum(ROWS).alias(rows_as), *[F.sum(name).alias(name) for name in sums], F.max("_valid").alias("_valid"),
        *[within(position).alias(name) for name, position in edges.items()]))
    found = groups.select(*keys, rows_as, *sums, "_valid", *[F.col(f"{name}.value").alias(name) for name in edges])
    open_edges = F.filter(F.array(*[F.struct(F.lit(name).alias("edge"), F.col(f"{name}.bin").alias("bin"), F.col(f"{name}.place").alias("place"),
                                             F.col(f"{name}.value").alias("value")) for name in edges]),
                          lambda e: e["bin"].isNotNull() & e["value"].isNull())
    wanted = groups.select(*keys, F.explode(open_edges).alias("e")).groupBy(*keys, F.col("e.bin").alias(BIN)).agg(
        F.collect_list(F.struct("e.edge", "e.place")).alias("_edges"))  # at most one entry per edge
    bins = wanted.count()
    if bins:
        found = found.unionByName(_inside(tallied.rows, wanted, bins, keys, list(edges)), allowMissingColumns=True)
        found = found.groupBy(*keys).agg(*[F.max(name).alias(name) for name in (rows_as, *sums, "_valid", *edges)])
    return found.select(
        *keys, rows_as, *sums,
        *[
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
             * (_position(q) - _lower(q))).alias(name)
            for name, q in quantiles.items()
        ],
    )


def _inside(rows: DataFrame, wanted: DataFrame, bins: int, keys: Sequence[str], edges: Sequence[str]) -> DataFrame:
    """Pass two: the value at each place of the wanted bins, one row per group and bin."""
    named = {name: f"_w_{name}" for name in (*keys, BIN)}
    target = wanted.withColumnsRenamed(named)
    same = all_of([F.col(name).eqNullSafe(F.col(other)) for name, other in named.items()])
    measured = rows.where(F.col(VALUE).isNotNull())  # rows without a value are in no wanted bin
    detail = measured.join(F.broadcast(target) if bins <= BROADCAST_BINS else target, same).groupBy(*keys, BIN, VALUE).agg(
        F.count(F.lit(1)).alias(ROWS), F.any_value("_edges").alias("_edges"))
    upto = Window.partitionBy(*keys, BIN).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(ROWS).over(upto)
    placed = detail.withColumns({"_to": end, "_from": end - F.col(ROWS)})
    picked = placed.withColumn("_edge", F.explode(F.filter("_edges", lambda e: (F.col("_from") <= e["place"]) & (e["place"] < F.col("_to")))))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_edge.edge") == name, F.col(VALUE))).alias(name) for name in edges])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, quantiles: Mapping[str, float],
                      rows_as: str = "rows", bin_width: float = HOUR_OF_DAY) -> DataFrame:
    column = F.col(value) if isinstance(value, str) else value
    return summarize(tally(df, keys, {}, column, bin_width), keys, rows_as, [], quantiles)


def small_quantile(column: Column | str, quantile: float) -> Column:
    """Interpolated quantile of a group known to be small: areas, boards, grid cells, months."""
    return F.percentile(column, F.lit(float(quantile)))


def approximate_quantile(column: Column | str, quantile: float, accuracy: int = 10000) -> Column:
    return F.percentile_approx(column, F.lit(float(quantile)), F.lit(accuracy))


def cut_points(df: DataFrame, by: Sequence[str], bucket: Column, order: Column,
               position: Column | DataFrame) -> DataFrame:
    """The ``order`` value at a 1-based position of each group, as (by..., position, cut).

    ``bucket`` must never decrease as ``order`` grows. Buckets are counted first, so only the
    rows of the bucket that holds the position are ranked. ``position`` is an expression over
    ``_total`` (rows of the group), or a table of (by..., position).
    """
    by = list(by)
    rows = df.select(*by, bucket.alias("_bucket"), order.alias("_order"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = (
        rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
        .withColumn("_end", F.sum("_in").over(upto))
    )
    if isinstance(position, DataFrame):
        histogram = histogram.join(position.select(*by, "position"), by)
    else:
        histogram = histogram.withColumn("_total", F.sum("_in").over(group)).withColumn("position", position)
    start = F.col("_end") - F.col("_in")
    hit = (
        histogram.where((start < F.col("position")) & (F.col("position") <= F.col("_end")))
        .select(*by, "position", "_bucket", (F.col("position") - start).alias("_nth"))
        .withColumnsRenamed({name: f"_h_{name}" for name in (*by, "_bucket")})
    )
    same = all_of([F.col(name).eqNullSafe(F.col(f"_h_{name}")) for name in (*by, "_bucket")])
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket", "position").orderBy("_order"))
    return (
        rows.join(hit, same).withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_nth"))
        .select(*by, "position", F.col("_order").alias("cut"))
    )


def key_order(key: str) -> Column:
    """A total order of keys of any type: none first, then integers by value, then all others by the digest of their text."""
    text, number = F.col(key).cast("string"), F.col(key).try_cast("bigint")
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    kind = F.when(text.isNull(), -1).when(number.isNotNull(), 0).otherwise(1)
    return F.struct(kind.alias("kind"), F.coalesce(number, digest, F.lit(0).cast("bigint")).alias("place"), text.alias("key"))


SPAN = ["kind", "low", "high"]


def _placed(wanted: DataFrame, counts: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """The entry of ``counts`` that holds each wanted place, and the place inside that entry."""
    upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("_end", F.sum(ROWS).over(upto)).withColumn("_start", F.col("_end") - F.col(ROWS))
    hit = wanted.join(ends, list(within)).where((F.col("_start") < F.col("nth")) & (F.col("nth") <= F.col("_end")))
    return hit.withColumn("nth", F.col("nth") - F.col("_start")).drop("_start", "_end")


def _in_spans(rows: DataFrame, hits: DataFrame, group: str) -> DataFrame:
    place = F.col("_order.place")
    spans = hits.select(group, *SPAN).distinct()
    return rows.withColumn("kind", F.col("_order.kind")).join(spans, [group, "kind"]).where((F.col("low") <= place) & (place <= F.col("high")))


def smallest_keys(df: DataFrame, group: str, key: str, positions: DataFrame, bins: int = 1 << 16, small: int = 100_000) -> DataFrame:
    """The key at each wanted position of its group, in the order of ``key_order``, as (group, position, cut).

    Keys are counted in bins; a bin that holds a wanted position and more than ``small`` rows is cut into bins
    anew, between its own least and greatest key. So clustered keys do not share a bin, and at most five rounds
    are needed. Repeated and missing keys are counted, not gathered. ``positions`` has a row per wanted position,
    some per area; the driver learns only whether a bin is still too large.
    """
    rows = df.select(group, key_order(key).alias("_order")).join(positions.select(group).distinct(), group, "left_semi")
    place = F.col("_order.place")
    bounds = [F.count(F.lit(1)).alias(ROWS), F.min(place).alias("_least"), F.max(place).alias("_most")]

    def narrowed(found: DataFrame) -> DataFrame:
        return cut_lineage(found.select(group, "position", "nth", ROWS, "kind", F.col("_least").alias("low"), F.col("_most").alias("high")))

    kinds = rows.groupBy(group, F.col("_order.kind").alias("kind")).agg(*bounds)
    hits = narrowed(_placed(positions.select(group, "position", F.col("position").alias("nth")), kinds, [group], "kind"))
    wide = (F.col(ROWS) > small) & (F.col("low") < F.col("high"))
    exact = "decimal(20,0)"  # the whole range of keys does not fit in a bigint
    width = F.floor((F.col("high").cast(exact) - F.col("low").cast(exact)) / F.lit(bins)) + 1
    while not hits.where(wide).isEmpty():
        open_hits = hits.where(wide).drop(ROWS)
        bin_of = F.floor((place.cast(exact) - F.col("low").cast(exact)) / width).cast("bigint")
        counts = _in_spans(rows, open_hits, group).groupBy(group, *SPAN, bin_of.alias("_at")).agg(*bounds)
        hits = narrowed(_placed(open_hits, counts, [group, *SPAN], "_at").drop("low", "high").unionByName(
            hits.where(~wide).withColumnsRenamed({"low": "_least", "high": "_most"}).withColumn("_at", F.lit(0).cast("bigint"))))
    orders = _in_spans(rows, hits, group).groupBy(group, *SPAN, "_order").agg(F.count(F.lit(1)).alias(ROWS))
    return _placed(hits.drop(ROWS), orders, [group, *SPAN], "_order").select(group, "position", F.col("_order").alias("cut"))
