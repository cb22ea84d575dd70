"""Personal data: patterns propose spans, check digits confirm them, nearby words adjust the score.

The words are looked for in the text around a match, past other matches: an entry of a list has the words of the list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.llm import spans
from reqlens.llm.common import identified_texts

THRESHOLD = 0.5  # of the score, for kinds that are not base kinds


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds the same matches as the stated grammar, without going back over long runs."""

    name: str
    grammar: str
    pattern: str
    base: bool
    score: float
    context: str = ""
    marker: str = ""  # a sign without which a text holds no match
    confirm: Callable[[Column], Column] = lambda value: F.lit(True)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    small = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, "[.]"), lambda part: (F.length(small(part)) <= 3) & (F.substring(small(part), 1, 3).cast("int") <= 255))


def _iban(value: Column) -> Column:
    """Country, check digits and account give 1 modulo 97 (letters as 10 to 35, the first four signs last)."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    number = lambda sign: F.conv(sign, 36, 10).cast("int")
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: (r * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97)
    return F.length(plain).between(15, 34) & (F.when(F.length(plain).between(15, 34), rest) == 1)


def _national_id(value: Column) -> Column:
    """Three, two and four digits; no area 000, 666 or 9xx, no group 00, no serial 0000."""
    return value.rlike("^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$") & ~value.rlike("^(000|666)|-00-|-0000$")


# Signs of an account number (IBAN) by country.
IBAN_LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27
GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28
PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
"""


def _iban_grammar() -> str:
    """Countries of one length, check digits, groups of four and the rest: the next word is never taken along."""
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    ways = []
    for length, countries in sorted(by_length.items()):
        groups, rest = divmod(length - 4, 4)
        last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        ways.append(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{last}\b")
    return "|".join(ways)


# The grammars are fixed values, as text: base kinds in their stated order, then the kinds added here.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         True, 0.9, "mail|contact|write|e-mail", "@"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, "ip|host|server|address", ".", _octets),
    Kind("card", r"[0-9]([\x20-]?[0-9])+",
         r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
         True, 0.7, "card|visa|credit|pay|iban", "", lambda value: F.call_function("luhn_check", _digits(value))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.7, "tel|phone|call|fax|mobil|cell", "+",
         lambda value: F.length(_digits(value)).between(10, 15)),
    Kind("iban", _iban_grammar(), rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_iban_grammar()})", False, 0.7, "iban|account|bank|konto|cuenta|compte", "", _iban),
    Kind("national_id", r"[0-9]+-[0-9]+-[0-9]+", r"[0-9](?<![0-9][0-9])[0-9]*+-[0-9]++-[0-9]++", False, 0.4,
         "ssn|social|security|insurance|passport", "-", _national_id),
    Kind("local_phone", r"\([0-9]{3}\)[\x20-][0-9]{3}-[0-9]{4}", r"\([0-9]{3}\)[\x20-][0-9]{3}-[0-9]{4}", False, 0.3,
         "tel|phone|call|fax|mobil|cell", "("),
)
BASE = tuple(kind for kind in KINDS if kind.base)
DOUBTS = "version|release|order|invoice|isbn|example"


def _score(kind: Kind, text: Column) -> Callable[[Column], Column]:
    """The kind's score, more with fitting words before or behind the match, less with words of harmless numbers before it."""

    def score(place: Column) -> Column:
        before, behind = F.lower(spans.before(text, place)), F.lower(spans.behind(text, place))
        return F.round(F.lit(kind.score) + F.when(before.rlike(kind.context) | behind.rlike(kind.context), 0.3).otherwise(0.0)
                       - F.when(before.rlike(DOUBTS), 0.2).otherwise(0.0), 6)

    return score


def _passes(kind: Kind) -> Callable[[Column], Column]:
    return lambda place: kind.confirm(place["value"])


def with_spans(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: all spans ``start, rank, stop, kind, score`` of the text column, and ``out`` + ``_base``.

    Base spans stay whatever their score; added kinds need the threshold and must not touch base spans.
    """
    found = rows.withColumns({f"{out}_{k.name}": F.when(F.instr(text, k.marker) > 0, spans.matches(F.col(text), k.pattern))
                              .otherwise(F.array().cast("array<string>")) if k.marker else spans.matches(F.col(text), k.pattern)
                              for k in KINDS})
    named = found.withColumns({f"{out}_{k.name}": spans.as_spans(
        F.filter(spans.located(F.col(text), F.col(f"{out}_{k.name}"), k.pattern), _passes(k)),
        k.name, i, _score(k, F.col(text))) for i, k in enumerate(KINDS)})
    base = named.withColumn(f"{out}_base", spans.in_order([F.col(f"{out}_{k.name}") for k in BASE]))
    more = F.filter(F.concat(*[F.col(f"{out}_{k.name}") for k in KINDS if not k.base]), lambda s: s["score"] >= THRESHOLD)
    return (base.withColumn(out, spans.in_order([F.col(f"{out}_base"), spans.apart_from(more, F.col(f"{out}_base"))]))
            .drop(*[f"{out}_{k.name}" for k in KINDS]))


def find_pii(documents: DataFrame) -> DataFrame:
    """``doc_id, spans, base_spans`` of every document, over its whole text.

    Null and empty texts have no spans. Repeated rows are searched each, null ids stay null, an empty
    table gives an empty result. Only ids and texts are read. One projection, no shuffle.
    """
    return with_spans(identified_texts(documents), "text", "spans").select("doc_id", "spans", F.col("spans_base").alias("base_spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span in ``text`` replaced by its kind, and ``n_chars`` of the new text.

    All other columns are kept as they are; a null text stays null.
    """
    columns = documents.columns
    own = "__pii"
    found = with_spans(documents.withColumn(f"{own}_text", F.coalesce("text", F.lit(""))), f"{own}_text", own)
    clean = F.when(F.col("text").isNotNull(), spans.replaced(F.col("text"), F.col(own)))
    result = found.withColumn("text", clean)
    if "n_chars" in columns:
        result = result.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return result.select(columns)


def pii_digest(documents: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the hash of the base spans and all spans as text."""
    found = find_pii(documents)
    return found.select(
        "doc_id", *[spans.count_of(F.col("base_spans"), k.name).cast("bigint").alias(f"n_{k.name}") for k in BASE],
        F.sha2(spans.digest(F.col("base_spans")), 256).alias("base_sha256"), spans.digest(F.col("spans")).alias("spans"))
