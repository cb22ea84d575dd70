"""Text normalisation and first-match rule expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.functions.cleaning import clean_string, known_string, strip_blanks
from reqlens.rules import MISDECODED_SEQUENCES

SEPARATOR = " | "
PLAIN = re.compile(r"[A-Za-z0-9 ,'/&-]+")  # an alternative that stands for itself


def normalize_text(column: Column | str) -> Column:
    """Lower case, only ``a-z 0-9 / & + -`` and single spaces; empty is null."""
    return _kept_runs(_repaired(F.coalesce(clean_string(column), F.lit(""))))


def add_normalized(df: DataFrame, texts: Mapping[str, Column | str]) -> DataFrame:
    """``normalize_text`` of several texts by projections of their own, as each step names the text before it several times.

    In one projection the steps would be written out within each other, and methods of over 8000 bytes are not compiled.
    """
    df = df.withColumns({name: strip_blanks(text) for name, text in texts.items()})
    df = df.withColumns({name: F.coalesce(known_string(name), F.lit("")) for name in texts})
    return df.withColumns({name: _repaired(F.col(name)) for name in texts}).withColumns({name: _kept_runs(F.col(name)) for name in texts})


def _repaired(text: Column) -> Column:
    repaired = text
    for bad, good in MISDECODED_SEQUENCES.items():
        repaired = F.replace(repaired, F.lit(bad), F.lit(good))
    # All sequences start with the same letter: most texts need no repair.
    return F.when(text.contains(next(iter(MISDECODED_SEQUENCES))[0]), repaired).otherwise(text)


def _kept_runs(text: Column) -> Column:
    """The runs of kept characters, joined: cheaper than replacing what lies between them."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9/&+-]+)"), F.lit(1))
    return F.nullif(F.array_join(runs, " "), F.lit(""))


def join_texts(descriptor: Column, details: Column) -> Column:
    """Both normalised texts around a separator, without dangling separators."""
    joined = F.concat(F.coalesce(descriptor, F.lit("")), F.lit(SEPARATOR), F.coalesce(details, F.lit("")))
    return F.btrim(joined, F.lit(" |"))


def matches(text: Column, pattern: str) -> Column:
    """``rlike``; alternatives without special characters are looked up as substrings, which is cheaper."""
    parts = [pattern] if re.search(r"[\\()\[\]{}]", pattern) else pattern.split("|")
    plain = [part for part in parts if PLAIN.fullmatch(part)]
    hits = [text.contains(F.lit(part)) for part in plain]
    if len(plain) < len(parts):
        hits.append(text.rlike("|".join(part for part in parts if part not in plain)))
    return reduce(lambda left, right: left | right, hits)


def any_match(columns: Sequence[str], pattern: str) -> Column:
    hits = [matches(F.coalesce(F.col(name), F.lit("")), pattern) for name in columns]
    return reduce(lambda left, right: left | right, hits)


def first_match(cases: Sequence[tuple[Column, int]]) -> Column:
    """Number of the first rule that holds, null when none does."""
    if not cases:
        return F.lit(None).cast("int")
    condition, number = cases[0]
    chain = F.when(condition, F.lit(number))
    for condition, number in cases[1:]:
        chain = chain.when(condition, F.lit(number))
    return chain
