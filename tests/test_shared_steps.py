"""Steps that many queries share: what they compute, and that they do it once."""

import datetime as dt
import re

from pyspark.sql import functions as F

from fixtures import equities as E
from fixtures import texts as X
from fixtures import views as V
from reqlens.contracts import RAW_COLUMNS
from reqlens.functions.text import add_normalized, matches, normalize_text
from reqlens.operators import frames, ngrams, taxonomy
from reqlens.rules import OUTCOME_RULES


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normalized_text_is_made_of_kept_runs(spark):
    given = ["  A\t b--c\n\nD ", "é x", "", "   ", None, "nan", "…", "a" * 3 + " İ" + "/&+-", "â\u0080\u0093 1"]
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("t"), r"[^a-z0-9/&+ -]+", " "), " +", " "))
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    made = [r[0] for r in rows.select(normalize_text("t")).collect()]
    assert made == ["a b--c d", "x", None, None, None, None, None, "aaa i /&+-", "- 1"]
    clean = rows.where("t not in ('nan') and not contains(t, 'â')")
    assert clean.where(~F.coalesce(normalize_text("t"), F.lit("")).eqNullSafe(plain)).count() == 0


def test_rule_alternatives_without_special_characters_match_like_the_pattern(spark):
    texts = ["old bolt", "an old bolt", "cold rolled | economy", "gear", "rod", "rods", "a.b", "axb", "", None, "x | y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("^old |old bolt", r"cold .* \| economy", "gear|rod$", "a.b|gear", "anvil", "gear||x", "(?i)GEAR|rod", " email |rod", "x|[|]"):
        assert rows.where(~matches(F.col("t"), pattern).eqNullSafe(F.col("t").rlike(pattern))).count() == 0, pattern


def test_outcome_rules_of_plain_words_need_no_patterns(spark):
    rows = spark.createDataFrame([("Please call us",)], "resolution_description string")
    made = taxonomy.classify_outcomes(rows, rules=OUTCOME_RULES)
    assert "RLIKE" not in plan(made)
    assert made.first()["resolution_outcome_group"] == "external_status_or_referral"


def test_terms_and_documents_are_counted_by_one_shuffle(spark):
    rows = spark.createDataFrame([("a", "#x bb bb #x", 2), ("a", "bb cc", 1), ("b", "bb", 5), ("b", None, 1)], "k string, t string, n bigint")
    made = ngrams.term_counts(rows, "t", [], F.col("n"), ["k"], pattern="([#a-z]{2,})")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in made.collect()} == {
        ("a", "#x", 4, 2), ("a", "bb", 5, 3), ("a", "cc", 1, 1), ("a", "#x bb", 2, 2), ("a", "bb bb", 2, 2), ("a", "bb #x", 2, 2),
        ("a", "bb cc", 1, 1), ("b", "bb", 5, 5)}


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_document_texts_are_normalized_once(spark, tmp_path):
    sf = documents(spark, tmp_path, [(1, "One two", "en"), (2, None, "en")])
    kept = X._document_families(spark, sf).where(F.col("text_clean").isNotNull())
    assert plan(kept).count("regexp_extract_all") == 1
    assert [r["text_clean"] for r in kept.collect()] == ["one two"]


def test_centres_of_a_text_that_two_families_share(spark, tmp_path):
    shared = [(i, f"word{i % 4} other{i % 3} thing", lang) for i in range(240) for lang in ("en", "fr")]
    extra = [(1000 + i, f"word{i % 9} last{i % 5}", "fr") for i in range(60)]
    sf = documents(spark, tmp_path, shared + extra)
    made = X.cluster_assignment(spark, sf).collect()
    assert {r["family"] for r in made} == {"en", "fr"} and {r["cluster"] for r in made} <= {0, 1, 2}
    for family in ("en", "fr"):
        own = sorted((r["text_key"], r["cluster"]) for r in made if r["family"] == family)
        assert [cluster for _, cluster in own[:3]] == [0, 1, 2]  # a centre is nearest to itself


def test_texts_are_stripped_once(spark):
    raw = spark.createDataFrame([tuple(" in-progress " if c == "status" else None for c in RAW_COLUMNS)],
                                ", ".join(f"`{c}` string" for c in RAW_COLUMNS))
    made = frames.clean_requests(raw)
    assert plan(made.select("status")).count("trim(") <= 1
    assert made.first()["status"] == "In-Progress"


def test_texts_normalized_by_projections_equal_the_expression(spark):
    given = ["  A\t b--c\n\nD ", "", "   ", None, "nan", " NULL ", "â\u0080\u0093 1", "\xa0It\u2003", "a â\u0080\u009cb\u3000"]
    rows = spark.createDataFrame([(t, t) for t in given], "t string, u string")
    made = add_normalized(rows, {"x": "t", "y": F.upper("u")})
    assert made.where(~F.col("x").eqNullSafe(normalize_text("t")) | ~F.col("y").eqNullSafe(normalize_text(F.upper("u")))).count() == 0


def test_generated_methods_of_the_enriched_table_are_small_enough_to_be_compiled(spark, tmp_path):
    kinds = {name: "timestamp_ntz" for name in ("created_date", "closed_date", "resolution_action_updated_date")}
    columns = [*RAW_COLUMNS, "resolution_description"]
    spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw").withColumn("city", F.col("resolution_description"))
    base = frames.add_lifecycle(frames.in_scope(frames.clean_requests(raw), V.SCOPE)).withColumn("resolution_description", F.col("city"))
    made = frames.enrich_inline(taxonomy.label_requests(base, V.RULES, V.MISMATCHES))
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(made._jdf.queryExecution(), "codegen")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # the JVM only interprets larger methods


def order_tables(spark, folder):
    """Orders with and without lines, areas and texts; one key twice, one null, which has no creation date."""
    day = dt.datetime(2000, 3, 1)
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"N{n}", 0) for n in (1, 7)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(c, (1, 7)[c % 2], 10.0 * c, "BUILDING") for c in range(60)], "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(0, "old bolt", "PROMO"), (1, "cold anvil", "ECONOMY")], "p_partkey bigint, p_name string, p_type string"),
        "orders": ([(key, i % 60, "FOP"[i % 3], day + dt.timedelta(days=i), ("1-URGENT", "2-HIGH", "5-LOW")[i % 3])
                    for i, key in enumerate([*range(90), 5, None])], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i, i % 2, day + dt.timedelta(days=2 * i)) for i in range(0, 90, 2)], "l_orderkey bigint, l_partkey bigint, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_equity_queries_write_the_columns_they_read(spark, tmp_path):
    sf = order_tables(spark, tmp_path)
    frame, _ = E._frame(spark, sf)
    assert not any(key[1:] == (sf, "enriched") for key in V._VIEWS)
    narrow = V.enriched(spark, sf, E.REQUEST_COLUMNS)
    scanned = spark.read.parquet(narrow.inputFiles()[0]).columns
    assert scanned == E.REQUEST_COLUMNS and "descriptor_norm" not in scanned
    narrow_rows, frame_rows = narrow.collect(), frame.count()
    whole = V.enriched(spark, sf)
    assert "resolution_outcome_group" in whole.columns
    assert sorted(map(repr, narrow_rows)) == sorted(map(repr, whole.select(*E.REQUEST_COLUMNS).collect()))
    assert frame_rows == len(narrow_rows) == 91
    again = V.enriched(spark, sf, E.REQUEST_COLUMNS)
    assert again.inputFiles() == whole.inputFiles()  # the whole table is there: nothing is written again
