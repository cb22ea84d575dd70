"""Secrets: known forms, and tokens that a battery of randomness tests cannot tell from random ones.

The encoding of a long token is the narrowest alphabet that has all its signs; every token has one. Separators that cut
a token into regular groups (8-4-4-4-12 hex signs, or three and more groups of one length, with a digit somewhere) belong
to no encoding and are left out first; words joined by dashes are not regular and keep them. Three tests ask whether the token could be
random in that alphabet: chi-squared uniformity, runs above and below the middle, and serial correlation.
Their p-values are combined by Fisher's method. Within each encoding and class of lengths the step-up
procedure of Benjamini and Hochberg decides, over all tokens of the corpus, which tokens are not random;
those that remain are added as spans. Lengths are kept apart since short tokens give the tests little power.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reqlens.llm import spans
from reqlens.llm.common import Scratch, identified_texts

FALSE_DISCOVERIES = 0.05
SHORTEST = 20  # signs of a token that is tested
P_STEP, P_BINS = 0.01, 1600  # p-values are rounded up to steps of this many decades, down to 1e-16
LENGTH_CLASSES = (24, 32, 40, 48, 64, 96, 128, 256)

# The base kinds in their stated order, as (kind, grammar, pattern). The patterns find the
# same matches that pass the stated length, without going back over long runs.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     r"""[PpSsTtAa](?i:(?<=p)ass(?:word|wd)|(?<=s)ecret|(?<=t)oken|(?<=a)pi_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}+"),
    ("hex", r"[0-9a-f]+", r"[0-9a-f](?<![0-9a-f]{2})[0-9a-f]{23,}+"),
)
VALUE_LENGTH = 6  # of an assigned value at least
TOKEN = rf"[A-Za-z0-9+/_-](?<![A-Za-z0-9+/_-]{{2}})[A-Za-z0-9+/_-]{{{SHORTEST - 1},}}+"
GROUP_LENGTHS = range(4, 17)
# Grouped tokens: groups of one length, or the usual form of unique ids.
GROUPED = "^(?=.*[0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|" + "|".join(
    f"[A-Za-z0-9]{{{n}}}(?:{sign}[A-Za-z0-9]{{{n}}}){{2,}}" for n in GROUP_LENGTHS for sign in "-_") + ")$"
# Encodings from the narrowest, the last one of all signs of a token: name, pattern of the whole token, alphabet in the order of values.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("digits", "^[0-9]+$", DIGITS),
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("upper_hex", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    ("upper_base36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("url_base64", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("all", "^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
)


def two_sided(z: Column) -> Column:
    """Probability of a normal value at least so far from zero (a rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.least(2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series, F.lit(1.0)), F.lit(1e-300))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def battery(value: Column, alphabet: Column) -> Column:
    """Combined p-value of the three tests for a token over an alphabet."""
    n, k = F.length(value).cast("double"), F.length(alphabet).cast("double")
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    later = lambda array: F.slice(array, F.lit(2), F.length(value) - 1)
    pairs = lambda array, f: total(F.zip_with(F.slice(array, F.lit(1), F.length(value) - 1), later(array), f))
    z_sum = lambda *z: -2 * sum((F.log(two_sided(x)) for x in z), F.lit(0.0))

    def of_signs(signs: Column) -> Column:
        squares = total(F.transform(F.array_distinct(signs), lambda c: F.pow(
            (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double"), F.lit(2.0))))
        uniform = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
        return let(F.transform(signs, lambda c: F.instr(alphabet, c).cast("double")), lambda numbers: of_numbers(numbers, uniform))

    def of_numbers(numbers: Column, uniform: Column) -> Column:
        moments = F.struct(
            uniform.alias("uniform"), total(numbers).alias("sum"), total(F.transform(numbers, lambda x: x * x)).alias("square"),
            pairs(numbers, lambda a, b: a * b).alias("cross"),
            total(F.transform(numbers, lambda x: F.when(x > k / 2, 1.0).otherwise(0.0))).alias("high"),
            pairs(numbers, lambda a, b: F.when((a > k / 2) != (b > k / 2), 1.0).otherwise(0.0)).alias("changes"),
            (F.element_at(numbers, 1) + F.element_at(numbers, -1)).alias("edges"))
        return let(moments, scores)

    def scores(m: Column) -> Column:
        both = 2 * m["high"] * (n - m["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        run = F.when(spread > 0, (m["changes"] - both / n) / F.sqrt(spread)).otherwise(F.sqrt(n))
        mean = m["sum"] / n
        variance = m["square"] - n * mean * mean
        cross = m["cross"] - mean * (2 * m["sum"] - m["edges"]) + (n - 1) * mean * mean
        serial = F.when(variance > 0, (cross / variance + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        return let(F.struct(m["uniform"].alias("u"), run.alias("r"), serial.alias("s")),
                   lambda z: let(z_sum(z["u"], z["r"], z["s"]), lambda x: F.exp(-x / 2) * (1 + x / 2 + x * x / 8)))

    return let(F.split(value, ""), of_signs)


def length_class(length: Column) -> Column:
    return reduce(lambda c, k: c.when(length <= LENGTH_CLASSES[k], k), range(1, len(LENGTH_CLASSES)),
                  F.when(length <= LENGTH_CLASSES[0], 0)).otherwise(len(LENGTH_CLASSES))


def tested_tokens(text: Column, found: Column) -> Column:
    """All tokens: place, stratum (encoding and length class), bin of the p-value."""
    alphabets = F.array(*[F.lit(alphabet) for _, _, alphabet in ENCODINGS])

    def bare(place: Column) -> Column:
        value = F.when(place["value"].rlike(GROUPED), F.translate(place["value"], "-_", "")).otherwise(place["value"])
        return F.struct(place["start"].alias("start"), place["stop"].alias("stop"), value.alias("value"))

    def inferred(place: Column) -> Column:
        encoding = reduce(lambda c, i: c.when(place["value"].rlike(ENCODINGS[i][1]), i), range(1, len(ENCODINGS)),
                          F.when(place["value"].rlike(ENCODINGS[0][1]), 0))
        return F.struct(place["start"].alias("start"), place["stop"].alias("stop"), place["value"].alias("value"), encoding.alias("encoding"))

    def judged(token: Column) -> Column:
        p = battery(token["value"], F.element_at(alphabets, token["encoding"] + 1))
        bin_ = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / P_STEP), F.lit(P_BINS)).cast("int")
        return F.struct(token["start"].alias("start"), token["stop"].alias("stop"),
                        (token["encoding"] * 100 + length_class(F.length(token["value"]))).alias("stratum"), bin_.alias("bin"))

    return F.transform(F.transform(F.transform(spans.located(text, found, TOKEN), bare), inferred), judged)


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, base, tokens``: the base spans and the tested tokens, in one pass over the texts."""
    rows = identified_texts(documents)
    found = rows.withColumns({**{f"m_{name}": spans.matches(F.col("text"), pattern) for name, _, pattern in BASE},
                              "m_token": spans.matches(F.col("text"), TOKEN)})
    enough = lambda p: F.length(F.regexp_extract(p["value"], r"""[:=]\x20*["']?(.*)$""", 1)) >= VALUE_LENGTH
    parts = []
    for rank, (name, _, pattern) in enumerate(BASE):
        places = spans.located(F.col("text"), F.col(f"m_{name}"), pattern)
        parts.append(spans.as_spans(F.filter(places, enough) if name == "assign" else places, name, rank, lambda p: F.lit(1.0)))
    return found.select("doc_id", spans.in_order(parts).alias("base"), tested_tokens(F.col("text"), F.col("m_token")).alias("tokens"))


def not_random_from(tokens: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Per stratum the smallest bin whose tokens are not random: the step-up procedure on counts of bins.

    A bin holds p-values below ``10 ** -(bin * P_STEP)``. At most one row per stratum reaches the driver.
    """
    counts = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("count"))
    # A stratum has at most P_BINS + 1 rows.
    up = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum")
    ranked = counts.withColumns({"below": F.sum("count").over(up), "all": F.sum("count").over(whole)})
    rejected = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") * P_STEP) <= rate * F.col("below") / F.col("all"))
    return {row["stratum"]: row["bin"] for row in rejected.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(documents: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``doc_id, spans, base_spans`` of every document, over its whole text.

    Spans of kind ``random`` are added where they touch no base span. Whether a token counts as random
    depends on all tokens of its encoding and length class in the given documents. Null and empty texts
    have no spans. Repeated rows are searched each, null ids stay null, an empty table gives an empty
    result. Only ids and texts are read, once; the tokens found are written to the shared folder.
    """
    scanned = Scratch(documents.sparkSession, "secrets").keep(scan(documents), "scanned")
    limits = not_random_from(scanned.select(F.explode("tokens").alias("t")).select("t.stratum", "t.bin"), rate)
    limit = lambda t: reduce(lambda c, s: c.when(t["stratum"] == s, limits[s]), limits, F.when(F.lit(False), 0)).otherwise(P_BINS + 1)
    random = F.filter("tokens", lambda t: t["bin"] < limit(t))
    more = spans.apart_from(spans.as_spans(random, "random", len(BASE), lambda t: F.lit(1.0)), F.col("base"))
    return scanned.select("doc_id", spans.in_order([F.col("base"), more]).alias("spans"), F.col("base").alias("base_spans"))


def secrets_digest(documents: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the hash of the base spans and all spans as text."""
    return find_secrets(documents).select(
        "doc_id", *[spans.count_of(F.col("base_spans"), n).cast("bigint").alias(f"n_{n}") for n, _, _ in BASE],
        F.sha2(spans.digest(F.col("base_spans")), 256).alias("base_sha256"), spans.digest(F.col("spans")).alias("spans"))
