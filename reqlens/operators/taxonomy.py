"""The text taxonomy: ordered rules as data, evaluated as one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reqlens.functions.cleaning import known_string, strip_blanks
from reqlens.functions.measures import rate_of
from reqlens.functions.text import add_normalized, any_match, first_match, join_texts, matches
from reqlens.operators.ranking import count_by, first_per_group
from reqlens.rules import (
    MISMATCH_RULES, NO_TEXT_OUTCOME, OTHER_OUTCOME, OUTCOME_RULES, SUBTYPE_RULES, MismatchRule,
    OutcomeRule, SubtypeRule)

UNMATCHED, NOT_MODELED = "other_unclassified", "not_modeled"


def clean_taxonomy_input(df: DataFrame) -> DataFrame:
    """Cleaning of the columns the taxonomy reads."""
    df = df.withColumns({name: strip_blanks(name) for name in ("complaint_type", "descriptor", "additional_details")})
    return df.withColumns({
        "complaint_type": F.coalesce(known_string("complaint_type"), F.lit("Unknown")),
        "descriptor": F.coalesce(known_string("descriptor"), F.lit("Unknown")),
        "additional_details": known_string("additional_details"),
    })


def add_normalized_text(df: DataFrame) -> DataFrame:
    df = add_normalized(df, {"descriptor_norm": "descriptor", "details_norm": "additional_details"})
    combined = join_texts(F.col("descriptor_norm"), F.col("details_norm"))
    return df.withColumn("combined_text", combined).withColumn(
        "text_clean", F.nullif(F.col("combined_text"), F.lit("")))


RULES_PER_STEP = 12


def _rule_number(df: DataFrame, rules: Mapping[str, Sequence[SubtypeRule]]) -> tuple[DataFrame, list[SubtypeRule]]:
    """Add ``_rule``, the number of the first matching rule; a row meets only its family's rules.

    Each step explodes a one-element array, which evaluates its rules exactly once per row. As
    a plain column, every later filter on a label would carry its own copy of all patterns
    towards the scan. Steps are short, so that each compiles into a method the JVM optimises,
    and a row that has its rule skips the later ones.
    """
    flat = [(family, rule) for family, family_rules in rules.items() for rule in family_rules]
    df = df.withColumn("_rule", F.lit(None).cast("int"))
    for start in range(0, len(flat), RULES_PER_STEP):
        step = list(enumerate(flat, start=1))[start:start + RULES_PER_STEP]
        chain = None
        for family in dict.fromkeys(family for _, (family, _) in step):
            cases = [(any_match(rule.columns, rule.pattern), number) for number, (owner, rule) in step if owner == family]
            here = F.col("complaint_type") == family
            chain = F.when(here, first_match(cases)) if chain is None else chain.when(here, first_match(cases))
        found = F.when(F.col("_rule").isNull(), chain).otherwise(F.col("_rule"))
        df = df.withColumn("_next", F.explode(F.array(found))).withColumn("_rule", F.col("_next")).drop("_next")
    return df, [rule for _, rule in flat]


def assign_subtypes(df: DataFrame, rules: Mapping[str, Sequence[SubtypeRule]] = SUBTYPE_RULES) -> DataFrame:
    """Family, subtype, confidence, source and quoted text of every request."""
    df, flat = _rule_number(df, rules)
    modeled = F.coalesce(F.col("complaint_type").isin(*rules), F.lit(False))

    def attribute(field: str, unmatched: str | None) -> Column:
        values = F.array(*[F.lit(getattr(rule, field)) for rule in flat]).cast("array<string>")
        found = F.get(values, F.col("_rule") - 1)
        if unmatched is None:
            return found
        return F.when(modeled, F.coalesce(found, F.lit(unmatched))).otherwise(F.lit(NOT_MODELED))

    quoted = attribute("match_column", None)
    return df.withColumns({
        "issue_family": F.col("complaint_type"),
        "subtype_modeled_flag": modeled,
        "issue_subtype": attribute("subtype", UNMATCHED),
        "issue_subtype_confidence": attribute("confidence", "low"),
        "subtype_source": attribute("source", "unmatched"),
        "subtype_match_text": F.when(quoted == "descriptor_norm", F.col("descriptor"))
        .when(quoted == "details_norm", F.col("additional_details"))
        .when(quoted.isNotNull(), F.col("combined_text")),
    }).drop("_rule")


def flag_label_mismatches(df: DataFrame, rules: Sequence[MismatchRule] = MISMATCH_RULES) -> DataFrame:
    """Unmatched requests whose text reads like another family; the last matching rule names it."""
    cases = [
        ((F.col("complaint_type") == rule.complaint_type) & any_match(rule.columns, rule.pattern), number)
        for number, rule in reversed(list(enumerate(rules, start=1)))
    ]
    open_row = F.col("issue_subtype") == UNMATCHED
    df = df.withColumn("_rule", F.when(open_row, first_match(cases)))
    families = F.array(*[F.lit(rule.suspected_family) for rule in rules]) if rules else F.array(F.lit(None).cast("string"))
    flagged = F.col("_rule").isNotNull()
    return df.withColumns({
        "potential_label_mismatch_flag": flagged,
        "mismatch_suspected_family": F.get(families, F.col("_rule") - 1),
        "mismatch_match_text": F.when(flagged, F.coalesce("descriptor", "additional_details")),
    }).drop("_rule")


def classify_outcomes(df: DataFrame, text: str = "resolution_description", eligible: Column | None = None,
                      rules: Sequence[OutcomeRule] = OUTCOME_RULES) -> DataFrame:
    """Closure outcome, confidence and text length of eligible rows; others are left null."""
    eligible = F.lit(True) if eligible is None else eligible
    df = add_normalized(df.withColumn("_eligible", eligible), {"_text": F.when(F.col("_eligible"), F.col(text))})
    df = df.withColumn("_text", F.when(F.col("_eligible"), F.coalesce("_text", F.lit("")))).drop("_eligible")
    number = first_match([(matches(F.col("_text"), rule.pattern), i) for i, rule in enumerate(rules, start=1)])
    df = df.withColumn("_rule", F.explode(F.array(number)))

    def pick(field: str, other: str) -> Column:
        found = F.get(F.array(*[F.lit(getattr(rule, field)) for rule in rules]), F.col("_rule") - 1)
        return F.when(F.col("_text").isNotNull(), F.coalesce(found, F.lit(other)))

    return df.withColumns({
        "resolution_outcome_group": pick("outcome", OTHER_OUTCOME[0]),
        "resolution_outcome_confidence": pick("confidence", OTHER_OUTCOME[1]),
        "resolution_text_length": F.length("_text").cast("bigint"),
    }).drop("_text", "_rule")


def fill_missing_outcomes(df: DataFrame) -> DataFrame:
    """Requests without closure text."""
    return df.withColumns({
        "resolution_has_text": F.col("resolution_outcome_group").isNotNull(),
        "resolution_outcome_group": F.coalesce("resolution_outcome_group", F.lit(NO_TEXT_OUTCOME[0])),
        "resolution_outcome_confidence": F.coalesce("resolution_outcome_confidence", F.lit(NO_TEXT_OUTCOME[1])),
    })


def has_closure_text(families: Sequence[str]) -> Column:
    text = F.col("resolution_description")
    return F.coalesce(F.col("complaint_type").isin(*families) & (F.trim(text) != ""), F.lit(False))


def attach_outcomes(df: DataFrame, closure_texts: DataFrame, rules: Sequence[OutcomeRule] = OUTCOME_RULES) -> DataFrame:
    """Outcomes of a separate closure-text table, by key."""
    features = classify_outcomes(closure_texts, rules=rules).drop("resolution_description")
    return fill_missing_outcomes(df.join(features, "unique_key", "left"))


def label_requests(df: DataFrame, rules: Mapping[str, Sequence[SubtypeRule]] = SUBTYPE_RULES,
                   mismatches: Sequence[MismatchRule] = MISMATCH_RULES,
                   outcomes: Sequence[OutcomeRule] | None = OUTCOME_RULES) -> DataFrame:
    """All labels of rows that carry their closure text: narrow projections, no join.

    ``outcomes=None`` leaves the closure texts unread.
    """
    labelled = flag_label_mismatches(assign_subtypes(add_normalized_text(clean_taxonomy_input(df)), rules), mismatches)
    if outcomes is None:
        return labelled
    return fill_missing_outcomes(classify_outcomes(labelled, eligible=has_closure_text(list(rules)), rules=outcomes))


# Summaries -----------------------------------------------------------------


def text_coverage(df: DataFrame, families: Sequence[str]) -> DataFrame:
    return df.groupBy("complaint_type").agg(
        F.count(F.lit(1)).alias("complaints"),
        rate_of(F.col("descriptor_norm").isNotNull()).alias("descriptor_rate"),
        rate_of(F.col("details_norm").isNotNull()).alias("details_rate"),
        rate_of(F.col("resolved_with_valid_date")).alias("resolution_rate"),
    ).withColumn("modeled", F.col("complaint_type").isin(*families))


def labelled_only(df: DataFrame) -> DataFrame:
    return df.where(~F.col("issue_subtype").isin(NOT_MODELED, UNMATCHED))


def subtype_summary(df: DataFrame) -> DataFrame:
    return df.where("subtype_modeled_flag").groupBy("complaint_type").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.size(F.collect_set("issue_subtype")).cast("bigint").alias("subtype_variants"),
        rate_of(F.col("issue_subtype") != UNMATCHED).alias("assigned_share"),
        rate_of(F.col("issue_subtype") == UNMATCHED).alias("residual_share"),
    )


def top_subtypes(df: DataFrame, n: int = 6) -> DataFrame:
    counts = count_by(labelled_only(df), "complaint_type", "issue_subtype")
    return first_per_group(counts, ["complaint_type"], n, F.desc("complaints"), F.asc("issue_subtype"))


def common_subtypes(df: DataFrame, minimum: int = 1000) -> DataFrame:
    return count_by(labelled_only(df), "issue_subtype").where(F.col("complaints") >= minimum).select("issue_subtype")


def residual_only(counts: DataFrame, label: str = "residual_cluster_label") -> DataFrame:
    """Drop the labels that stand for a missing cluster."""
    return counts.where(~F.col(label).isin("missing", "<NA>", "nan", "None"))
