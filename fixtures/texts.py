"""Text normalisation, rules, outcomes, n-grams, clustering and their summaries."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Window, functions as F

from fixtures import sql as S
from fixtures import views as V
from fixtures.registry import query, rounded
from fixtures.sql import PARTIAL, quote, with_
from reqlens.functions.text import normalize_text
from reqlens.operators import clustering, ngrams, ranking, summaries, taxonomy
from reqlens.rules import MISMATCH_RULES, OUTCOME_RULES, SUBTYPE_RULES, TARGET_FAMILIES

# Python string blanks differ from SQL trim; document texts may start or end with line breaks.
BLANK_TRIM = "trim({c}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"


def _normalize_any(column: str) -> str:
    return S.normalize(column).replace(f"trim({column})", BLANK_TRIM.format(c=column))


@query("text_normalize", f"SELECT doc_id, {_normalize_any('text')} AS text_norm FROM documents")
def text_normalize(spark, sf):
    return V.documents(spark, sf).select("doc_id", normalize_text("text").alias("text_norm"))


SUBTYPE_COLUMNS = ["unique_key", "text_clean", "issue_family", "subtype_modeled_flag", "issue_subtype",
                   "issue_subtype_confidence", "subtype_source", "subtype_match_text"]


@query("rule_subtypes", with_(S.LABELLED, f"SELECT {', '.join(SUBTYPE_COLUMNS)} FROM labelled"))
def rule_subtypes(spark, sf):
    return V.labelled(spark, sf).select(*SUBTYPE_COLUMNS)


MISMATCH_COLUMNS = ["unique_key", "potential_label_mismatch_flag", "mismatch_suspected_family", "mismatch_match_text"]


@query("label_mismatch", with_(S.LABELLED, f"SELECT {', '.join(MISMATCH_COLUMNS)} FROM labelled"))
def label_mismatch(spark, sf):
    return V.labelled(spark, sf).select(*MISMATCH_COLUMNS)


OUTCOME_COLUMNS = ["unique_key", "resolution_has_text", "resolution_outcome_group", "resolution_outcome_confidence", "resolution_text_length"]


def _outcome_columns(df):
    """The nullable length as a double, which both engines return alike."""
    return df.select(*OUTCOME_COLUMNS).withColumn("resolution_text_length", F.col("resolution_text_length").cast("double"))


@query("closure_outcome", with_(S.LABELLED, f"SELECT * REPLACE (CAST(resolution_text_length AS DOUBLE) AS resolution_text_length) FROM (SELECT {', '.join(OUTCOME_COLUMNS)} FROM labelled)"))
def closure_outcome(spark, sf):
    return _outcome_columns(V.labelled(spark, sf))


@query("closure_outcome_joined", with_(S.LABELLED, f"SELECT * REPLACE (CAST(resolution_text_length AS DOUBLE) AS resolution_text_length) FROM (SELECT {', '.join(OUTCOME_COLUMNS)} FROM labelled)"))
def closure_outcome_joined(spark, sf):
    """The same outcomes from a separate closure-text table, joined by key."""
    from reqlens.operators.filters import closure_text_scan

    raw = V.raw_requests(spark, sf, text=True)
    texts = closure_text_scan(raw, list(V.RULES), V.SCOPE.start).withColumn("unique_key", F.col("unique_key").cast("string"))
    return _outcome_columns(taxonomy.attach_outcomes(V.analytic(spark, sf).select("unique_key"), texts))


# The full rule list, over requests whose type and texts are phrases chosen by keys.
FAMILIES = [*TARGET_FAMILIES, "Noise - Vehicle", "Graffiti"]
DESCRIPTORS = [
    "Blocked Hydrant", "Loud Music/Party", "ENTIRE BUILDING", "No Access", "Partial Access", "PESTS", "Pothole",
    "Cave-in", "Hydrant Running (WC3)", "Dirty Water", "BOILER", "RADIATOR", "Trash", "WALL", "Banging/Pounding",
    "Double Parked Blocking Traffic", "Detached Trailer", "Mold", "Wear & Tear", "Leak (Use Comments)", "Plate Condition - Noisy",
    "Line/Marking - Faded", "STEAM PIPE/RISER", "Broken Glass", "Failed Street Repair", "License Plate Obscured",
    "Strip Paving", "GARBAGE/RECYCLING STORAGE", "Loud Talking", "No Water", "Syringes", "Other",
]
DETAILS = [
    "NO HEAT", "NO HEAT AND NO HOT WATER", "NO HOT WATER", "MISSING OR REMOVED", "BROKEN", "Littering",
    "CHIPPED/PEELING/FLAKING", "HOLE OR CRACKED", "SINK DETACHED FROM WALL", "Front of fire hydrant", "DRAIN PIPE BLOCKED OR BROKEN",
    "BASIN MISSING", "Not picked up by dog owner", "DIRTY OR UNSANITARY", "LOOSE OR WOBBLY", "MICE", "Parked at bus stop", "None", "Basement",
]


def _choose(column: str, values) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


PHRASES = f"""SELECT o_orderkey AS unique_key, {_choose('o_orderkey', FAMILIES)} AS complaint_type,
  {_choose('o_custkey', DESCRIPTORS)} AS descriptor, {_choose('(o_custkey + o_orderkey)', DETAILS)} AS additional_details FROM orders"""
CLEANED = f"SELECT * REPLACE ({S.clean('additional_details')} AS additional_details) FROM ({PHRASES})"
FULL = f"phrases AS ({CLEANED})," + S.subtype_ctes("phrases", SUBTYPE_RULES, MISMATCH_RULES)


@query("full_rule_list", with_(FULL, f"SELECT {', '.join(SUBTYPE_COLUMNS + MISMATCH_COLUMNS[1:])} FROM flagged"))
def full_rule_list(spark, sf):
    phrases = spark.sql(PHRASES.replace("FROM orders", "FROM {orders}"), orders=V.table(spark, sf, "orders"))
    labelled = taxonomy.flag_label_mismatches(taxonomy.assign_subtypes(
        taxonomy.add_normalized_text(taxonomy.clean_taxonomy_input(phrases))))
    return labelled.select(*SUBTYPE_COLUMNS, *MISMATCH_COLUMNS[1:])


@query("document_outcomes", f"""SELECT resolution_outcome_group, count(*) AS texts, CAST(sum(length(closure_norm)) AS BIGINT) AS characters
    FROM (SELECT closure_norm, {S.outcome_case(lambda r: r.outcome, 'other_resolution_language')} AS resolution_outcome_group
      FROM (SELECT coalesce({_normalize_any('text')}, '') AS closure_norm FROM documents)) GROUP BY 1""")
def document_outcomes(spark, sf):
    """Closure rules over whole documents."""
    out = taxonomy.classify_outcomes(V.documents(spark, sf), text="text", rules=OUTCOME_RULES)
    return out.groupBy("resolution_outcome_group").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("resolution_text_length").alias("characters"))


# Summaries -----------------------------------------------------------------------


@query("text_coverage", with_(S.LABELLED, f"""SELECT complaint_type, count(*) AS complaints, round(avg(CAST(descriptor_norm IS NOT NULL AS INT)), 6) AS descriptor_rate,
    round(avg(CAST(details_norm IS NOT NULL AS INT)), 6) AS details_rate, round(avg(CAST(resolved_with_valid_date AS INT)), 6) AS resolution_rate,
    complaint_type IN ({', '.join(quote(f) for f in V.RULES)}) AS modeled FROM labelled GROUP BY 1"""))
def text_coverage(spark, sf):
    return rounded(taxonomy.text_coverage(V.enriched(spark, sf), list(V.RULES)), "descriptor_rate", "details_rate", "resolution_rate")


@query("subtype_summary", with_(S.LABELLED, """SELECT complaint_type, count(*) AS complaints, count(DISTINCT issue_subtype) AS subtype_variants,
    round(avg(CAST(issue_subtype <> 'other_unclassified' AS INT)), 6) AS assigned_share, round(avg(CAST(issue_subtype = 'other_unclassified' AS INT)), 6) AS residual_share
    FROM labelled WHERE subtype_modeled_flag GROUP BY 1"""))
def subtype_summary(spark, sf):
    return rounded(taxonomy.subtype_summary(V.enriched(spark, sf)), "assigned_share", "residual_share")


LABEL_ONLY = "issue_subtype NOT IN ('not_modeled', 'other_unclassified')"


@query("top_subtypes", with_(S.LABELLED, f"""SELECT complaint_type, issue_subtype, complaints FROM (SELECT complaint_type, issue_subtype, count(*) AS complaints,
    row_number() OVER (PARTITION BY complaint_type ORDER BY count(*) DESC, issue_subtype) AS rn FROM labelled WHERE {LABEL_ONLY} GROUP BY 1, 2) WHERE rn <= 2"""))
def top_subtypes(spark, sf):
    return taxonomy.top_subtypes(V.enriched(spark, sf), 2)


@query("largest_subtype", with_(S.LABELLED, f"""SELECT complaint_type, issue_subtype, count(*) AS complaints FROM labelled WHERE {LABEL_ONLY}
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1"""))
def largest_subtype(spark, sf):
    return summaries.top_label_findings(V.enriched(spark, sf))


@query("top_modeled_subtypes", with_(S.LABELLED, """SELECT issue_subtype, count(*) AS complaints FROM labelled WHERE subtype_modeled_flag GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4"""))
def top_modeled_subtypes(spark, sf):
    return summaries.top_modeled_subtypes(V.enriched(spark, sf))


@query("text_overall", with_(S.LABELLED, """SELECT count(*) AS complaints, round(avg(CAST(subtype_modeled_flag AS INT)), 6) AS modeled_share,
    round(avg(CAST(potential_label_mismatch_flag AS INT)), 6) AS mismatch_share, round(avg(CAST(resolution_outcome_group <> 'no_resolution_text' AS INT)), 6) AS resolution_text_share,
    round(avg(CAST(issue_subtype_confidence = 'high' AS INT)), 6) AS high_confidence_subtype_share FROM labelled"""))
def text_overall(spark, sf):
    return rounded(summaries.text_overall(V.enriched(spark, sf)), "modeled_share", "mismatch_share", "resolution_text_share", "high_confidence_subtype_share")


@query("type_coverage", with_(S.LABELLED, f"""SELECT s.*, coalesce(f.top_issue_family, 'Unknown') AS top_issue_family, t.top_issue_subtype FROM (
    SELECT complaint_type, count(*) AS complaints, round(avg(CAST(subtype_modeled_flag AS INT)), 6) AS subtype_modeled_share,
      round(avg(CAST(potential_label_mismatch_flag AS INT)), 6) AS mismatch_share FROM labelled GROUP BY 1) s
    LEFT JOIN {S.mode_table('labelled', ['complaint_type'], 'issue_family', 'top_issue_family')} f USING (complaint_type)
    LEFT JOIN {S.mode_table('labelled', ['complaint_type'], 'issue_subtype', 'top_issue_subtype', 'subtype_modeled_flag')} t USING (complaint_type)"""))
def type_coverage(spark, sf):
    return rounded(summaries.type_coverage(V.enriched(spark, sf)), "subtype_modeled_share", "mismatch_share")


for _name, _key in (("subtype_source_counts", "subtype_source"), ("outcome_counts", "resolution_outcome_group"),
                    ("outcome_confidence_counts", "resolution_outcome_confidence"), ("issue_family_counts", "issue_family")):
    query(_name, with_(S.LABELLED, f"SELECT {_key}, count(*) AS complaints FROM labelled GROUP BY 1"))(
        lambda spark, sf, key=_key: ranking.count_by(V.enriched(spark, sf), key))

for _name, _key in (("outcome_by_type", "complaint_type"), ("outcome_by_agency", "agency")):
    query(_name, with_(S.LABELLED, f"SELECT resolution_outcome_group, {_key}, count(*) AS complaints FROM labelled GROUP BY 1, 2"))(
        lambda spark, sf, key=_key: ranking.count_by(V.enriched(spark, sf), "resolution_outcome_group", key))


@query("outcome_leaders", with_(S.LABELLED, """SELECT agency, count(*) AS complaints FROM labelled WHERE resolution_outcome_group = 'summons_issued'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"""))
def outcome_leaders(spark, sf):
    counts = ranking.count_by(V.enriched(spark, sf), "resolution_outcome_group", "agency")
    return ranking.rank_view(counts.where("resolution_outcome_group = 'summons_issued'"), "complaints", 3, ["agency"]).select("agency", "complaints")


COMMON = f"common AS (SELECT issue_subtype FROM labelled WHERE {LABEL_ONLY} GROUP BY 1 HAVING count(*) >= 300)"


@query("subtype_durations", with_(S.LABELLED + "," + COMMON, """SELECT complaint_type, issue_subtype, count(*) AS complaints, round(quantile_cont(resolution_days, 0.5), 6) AS median_days,
    round(quantile_cont(resolution_days, 0.9), 6) AS p90_days FROM labelled WHERE resolved_with_valid_date AND issue_subtype IN (FROM common) GROUP BY 1, 2"""))
def subtype_durations(spark, sf):
    return rounded(summaries.subtype_durations(V.enriched(spark, sf), 300), "median_days", "p90_days")


@query("outcomes_by_subtype", with_(S.LABELLED + "," + COMMON, """SELECT complaint_type, issue_subtype, resolution_outcome_group, complaints FROM (
    SELECT complaint_type, issue_subtype, resolution_outcome_group, count(*) AS complaints,
      row_number() OVER (PARTITION BY complaint_type, issue_subtype ORDER BY count(*) DESC, resolution_outcome_group) AS rn
    FROM labelled WHERE issue_subtype IN (FROM common) AND resolution_outcome_group <> 'no_resolution_text' GROUP BY 1, 2, 3) WHERE rn <= 3"""))
def outcomes_by_subtype(spark, sf):
    return summaries.outcomes_by_subtype(V.enriched(spark, sf), 300, 3)


@query("mix_shift", with_(S.LABELLED + "," + COMMON + f""", latest AS (SELECT max(created_date) AS last FROM labelled WHERE created_year = {PARTIAL}),
  counts AS (SELECT complaint_type, issue_subtype, created_year = {PARTIAL} AS late, count(*) AS n FROM labelled, latest WHERE issue_subtype IN (FROM common) AND (
    (created_date >= TIMESTAMP '{V.SCOPE.base_year}-01-01' AND created_date <= last - INTERVAL 1 YEAR) OR (created_date >= TIMESTAMP '{PARTIAL}-01-01' AND created_date <= last)) GROUP BY 1, 2, 3),
  shares AS (SELECT complaint_type, issue_subtype, late, n / CAST(sum(n) OVER (PARTITION BY complaint_type, late) AS DOUBLE) AS share FROM counts)""", """
  SELECT complaint_type, issue_subtype, round(coalesce(max(share) FILTER (WHERE NOT late), 0), 6) AS base_share, round(coalesce(max(share) FILTER (WHERE late), 0), 6) AS partial_share,
    round(coalesce(max(share) FILTER (WHERE late), 0) - coalesce(max(share) FILTER (WHERE NOT late), 0), 6) AS share_change,
    round((coalesce(max(share) FILTER (WHERE late), 0) - coalesce(max(share) FILTER (WHERE NOT late), 0)) * 100, 6) AS share_change_pct_points
  FROM shares GROUP BY 1, 2"""))
def mix_shift(spark, sf):
    return rounded(summaries.mix_shift(V.enriched(spark, sf), V.SCOPE, 300), "base_share", "partial_share", "share_change", "share_change_pct_points")


# N-grams and clusters ------------------------------------------------------------

STOP_WORDS = ("a an and are as at be by for from has have he in is it its of on or that the this to was were will with "
              "not but they you we she his her their").split()
ASCII_TOKEN = "([a-z0-9_]{2,})"
STOPS = ", ".join(quote(w) for w in STOP_WORDS)
TERMS = f"""words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({STOPS})) AS w FROM documents),
terms AS (SELECT doc_id, unnest(w) AS ngram FROM words
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1))"""


@query("ngram_counts", with_(TERMS, "SELECT ngram, count(*) AS count FROM terms GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5 ORDER BY 2 DESC, 1 LIMIT 15"))
def ngram_counts(spark, sf):
    return ngrams.top_ngrams(V.documents(spark, sf), "text", 15, 5, STOP_WORDS, ASCII_TOKEN)


@query("ngram_documents", with_(TERMS, "SELECT ngram, count(*) AS count, count(DISTINCT doc_id) AS documents FROM terms GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5"))
def ngram_documents(spark, sf):
    return ngrams.term_counts(V.documents(spark, sf), "text", STOP_WORDS, pattern=ASCII_TOKEN).where("documents >= 5")


def _document_families(spark, sf):
    """Exploded from a one-element array: a filter on the text then does not normalise it once more."""
    documents = V.documents(spark, sf).select(
        F.col("doc_id").alias("unique_key"), F.col("lang").alias("complaint_type"), F.explode(F.array(normalize_text("text"))).alias("text_clean"))
    return documents.withColumn("issue_subtype", F.lit(taxonomy.UNMATCHED))


# The assignment step: the three texts of a family with the least digests are its centres.
ASSIGNMENT = f"""families AS (SELECT lang AS family, {_normalize_any('text')} AS point FROM documents),
texts AS (SELECT family, point, count(*) AS n FROM families WHERE point IS NOT NULL AND family IS NOT NULL GROUP BY 1, 2),
kept AS (SELECT family, sum(n) AS total FROM texts GROUP BY 1 HAVING sum(n) >= 100 AND count(*) >= 2),
cluster_words AS (SELECT family, point, n, list_filter(regexp_extract_all(lower(point), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({STOPS})) AS w FROM texts JOIN kept USING (family)),
cluster_terms AS MATERIALIZED (SELECT family, point, n, unnest(w) AS ngram FROM cluster_words
  UNION ALL SELECT family, point, n, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM cluster_words WHERE len(w) > 1)),
tf AS MATERIALIZED (SELECT family, point, n, ngram, count(*) AS tf FROM cluster_terms GROUP BY 1, 2, 3, 4),
ranked_terms AS (SELECT family, ngram, sum(n) AS documents, row_number() OVER (PARTITION BY family ORDER BY sum(n * tf) DESC, ngram) AS place
  FROM tf GROUP BY 1, 2 HAVING sum(n) >= 5),
raw_vectors AS (SELECT tf.family, point, tf.ngram, tf * (ln((1 + total) / CAST(1 + documents AS DOUBLE)) + 1) AS v
  FROM tf JOIN ranked_terms r ON tf.family = r.family AND tf.ngram = r.ngram AND place <= 1500 JOIN kept k ON tf.family = k.family),
vectors AS MATERIALIZED (SELECT family, point, ngram, v / sqrt(sum(v * v) OVER (PARTITION BY family, point)) AS v FROM raw_vectors),
centre_texts AS (SELECT family, point, row_number() OVER (PARTITION BY family ORDER BY md5(point)) - 1 AS cluster FROM texts JOIN kept USING (family)
  QUALIFY row_number() OVER (PARTITION BY family ORDER BY md5(point)) <= 3),
lengths AS (SELECT family, point, sum(v * v) AS s FROM vectors GROUP BY 1, 2),
centre_vectors AS MATERIALIZED (SELECT c.family, c.cluster, y.ngram, y.v FROM centre_texts c JOIN vectors y ON y.family = c.family AND y.point = c.point),
dots AS (SELECT x.family, x.point, y.cluster, sum(x.v * y.v) AS dot FROM vectors x JOIN centre_vectors y ON x.family = y.family AND x.ngram = y.ngram GROUP BY 1, 2, 3),
distances AS (SELECT t.family, t.point, t.n, c.cluster, greatest(round(coalesce(lx.s, 0) + coalesce(lc.s, 0) - 2 * coalesce(d.dot, 0), 9), 0) AS distance
  FROM texts t JOIN kept USING (family) JOIN centre_texts c ON t.family = c.family LEFT JOIN lengths lx ON lx.family = t.family AND lx.point = t.point
  LEFT JOIN lengths lc ON lc.family = c.family AND lc.point = c.point LEFT JOIN dots d ON d.family = t.family AND d.point = t.point AND d.cluster = c.cluster)"""


@query("cluster_assignment", with_(ASSIGNMENT, """SELECT family, md5(point) AS text_key, CAST(n AS DOUBLE) AS weight, arg_min(cluster, (distance, cluster)) AS cluster
    FROM distances GROUP BY 1, 2, 3"""))
def cluster_assignment(spark, sf):
    made = ngrams.family_vectors(_document_families(spark, sf), min_rows=100, stop_words=STOP_WORDS, pattern=ASCII_TOKEN)
    first = F.row_number().over(Window.partitionBy("family").orderBy("digest"))
    digests = made.points.select("family", F.md5("point").alias("digest"))  # only digests are sorted
    leading = digests.withColumn("turn", first).where("turn <= 3").collect()
    turns = {(row["family"], row["digest"]): row["turn"] for row in leading}
    chosen = made.points.where(F.md5("point").isin(sorted({row["digest"] for row in leading}))).collect()
    centres = {name: np.zeros((3, len(terms))) for name, terms in made.vocabulary.items()}
    for row in chosen:
        turn = turns.get((row["family"], hashlib.md5(row["point"].encode()).hexdigest()))
        if turn is None:  # the text of another family's centre
            continue
        centres[row["family"]][turn - 1, np.frombuffer(bytes(row["keys"]), "<i4")] = np.frombuffer(bytes(row["numbers"]), "<f8")
    placed = clustering.assign(made.points, centres)
    return placed.select("family", F.md5("point").alias("text_key"), "weight", "cluster")


@query("residual_cluster_profiles")
def residual_cluster_profiles(spark, sf):
    _, profiles = ngrams.residual_clusters(_document_families(spark, sf), min_rows=100, stop_words=STOP_WORDS)
    return rounded(profiles, "cluster_share")


@query("residual_counts")
def residual_counts(spark, sf):
    documents = _document_families(spark, sf)
    assignments, _ = ngrams.residual_clusters(documents, min_rows=100, stop_words=STOP_WORDS)
    counts = summaries.residual_counts(ngrams.attach_clusters(documents, assignments))
    return taxonomy.residual_only(counts)
