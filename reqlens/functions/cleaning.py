"""Cleaning and coercion of raw string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Strings that mean "missing", and the characters stripped around values.
MISSING_TOKENS = ("", "nan", "None", "NULL", "NaN")
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip_blanks(column: Column | str) -> Column:
    """Strip all Unicode blanks. Few values have any, and looking at both ends is cheaper."""
    text = _col(column).cast("string")
    at_edge = F.left(text, F.lit(1)).isin(*BLANKS) | F.right(text, F.lit(1)).isin(*BLANKS)
    return F.when(at_edge, F.btrim(text, F.lit(BLANKS))).otherwise(text)


def clean_string(column: Column | str, extra_missing: Sequence[str] = ()) -> Column:
    """Strip blanks; empty and null-like tokens become null."""
    return known_string(strip_blanks(column), extra_missing)


def known_string(text: Column | str, extra_missing: Sequence[str] = ()) -> Column:
    """Null-like tokens of a stripped text become null."""
    text = _col(text)
    return F.when(~text.isin(*MISSING_TOKENS, *extra_missing), text)


def title_case(column: Column | str) -> Column:
    """Capitalise every run of letters, also after ``-`` or ``'`` (``initcap`` does not)."""
    text = _col(column)
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")
    return F.when(text.rlike(r"[^\p{L} ]"), by_run).otherwise(F.initcap(text))


def to_double(column: Column | str) -> Column:
    """Lenient number: anything unparsable, and NaN, is null."""
    number = strip_blanks(column).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_long(column: Column | str) -> Column:
    return to_double(column).try_cast("bigint")


def to_timestamp_lenient(column: Column | str, pattern: str | None = None) -> Column:
    text = _col(column).cast("string")
    parsed = F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)
    return parsed.cast("timestamp_ntz")


def rerender_date(column: Column | str, source: str, target: str) -> Column:
    return F.date_format(F.try_to_timestamp(_col(column), F.lit(source)), target)


def zip_code(column: Column | str) -> Column:
    """First run of five digits anywhere in the value."""
    return F.regexp_substr(_col(column).cast("string"), F.lit("[0-9]{5}"))


def _group_or_null(column: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def board_code(board: Column | str) -> Column:
    return _group_or_null(_col(board), r"^([0-9]{2})")


def board_borough(board: Column | str, borough: Column | str) -> Column:
    """Trailing capitals of the board name, else the borough of the request."""
    return F.coalesce(_group_or_null(_col(board), r"([A-Z][A-Z ]+)$"), _col(borough))
