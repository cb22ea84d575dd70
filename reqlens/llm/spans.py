"""Places of pattern matches in texts, as columns: no Python runs on the executors.

Spark's functions give matches but not their places. The pieces between the matches do: the start of a
match is the length of all that stands before it. Places count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

CONTEXT = 40  # code points before a match, and behind it, that count as its context
FOUND = "array<struct<start:int,stop:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, found: Column, pattern: str) -> Column:
    """Matches with their places; ``found`` are the text's matches."""
    pieces = F.split(text, pattern, -1)

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + F.length(item["piece"])
        stop = start + F.length(item["value"])
        one = F.struct(start.alias("start"), stop.alias("stop"), item["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out")), step, lambda state: state["out"])
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(FOUND))


def before(text: Column, place: Column) -> Column:
    """The text shortly before a place, whatever matches it holds."""
    start = F.greatest(place["start"] - CONTEXT, F.lit(0))
    return F.substring(text, start + 1, place["start"] - start)


def behind(text: Column, place: Column) -> Column:
    """The text shortly behind a place."""
    return F.substring(text, place["stop"] + 1, F.lit(CONTEXT))


def as_spans(places: Column, kind: str, rank: int, score) -> Column:
    """Places as spans; ``score`` makes a column of a place."""
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["stop"].alias("stop"),
                                                  F.lit(kind).alias("kind"), score(p).cast("double").alias("score")))


def in_order(parts: Sequence[Column]) -> Column:
    """All spans by start, then rank of the kind."""
    return F.array_sort(F.concat(*parts))


def apart_from(extra: Column, base: Column) -> Column:
    """Spans of ``extra`` that touch no span of ``base``."""
    return F.filter(extra, lambda e: ~F.exists(base, lambda b: (b["start"] < e["stop"]) & (e["start"] < b["stop"])))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``<kind>``; of overlapping spans the first one names the gap."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], F.array(kept))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)
