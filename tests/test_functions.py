from datetime import datetime

from pyspark.sql import functions as F

from reqlens.contracts import DEFAULT_BOX, Scope, SEASON_ORDER
from reqlens.functions import cleaning as C
from reqlens.functions import lifecycle as L
from reqlens.functions import measures as M
from reqlens.functions.text import join_texts, normalize_text
from reqlens.operators.frames import add_lifecycle, apply_defaults


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row[0] for row in df.orderBy("i").select(expression).collect()]


def test_clean_string_strips_and_nulls(spark):
    values = [" a ", "", "nan", "None", "NULL", "NaN", "Unspecified", None, "　b\t"]
    assert column(spark, values, "string", C.clean_string("x")) == ["a", None, None, None, None, None, "Unspecified", None, "b"]
    assert column(spark, ["Unspecified"], "string", C.clean_string("x", ("Unspecified",))) == [None]


def test_title_case_after_punctuation(spark):
    assert column(spark, ["in-progress o'neil", "OPEN now", None], "string", C.title_case("x")) == ["In-Progress O'Neil", "Open Now", None]


def test_lenient_numbers(spark):
    assert column(spark, ["1.5", " 2 ", "x", "nan", None], "string", C.to_double("x")) == [1.5, 2.0, None, None, None]
    assert column(spark, ["7", "7.0", "n/a"], "string", C.to_long("x")) == [7, 7, None]


def test_zip_and_board(spark):
    assert column(spark, ["10001-123", "NY 11215", "123", None], "string", C.zip_code("x")) == ["10001", "11215", None, None]
    boards = ["07 STATEN ISLAND", "Unspecified", "12 QUEENS"]
    assert column(spark, boards, "string", C.board_code("x")) == ["07", None, "12"]
    assert column(spark, boards, "string", C.board_borough("x", F.lit("BRONX"))) == ["STATEN ISLAND", "BRONX", "QUEENS"]


def test_dates_padded_and_not(spark):
    expression = C.rerender_date("x", "M/d/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss")
    assert column(spark, ["01/02/2025 03:04:05 PM", "1/2/2025 3:04:05 AM", "junk", None], "string", expression) == [
        "2025-01-02 15:04:05", "2025-01-02 03:04:05", None, None]


def test_seasons_and_buckets(spark):
    assert column(spark, list(range(1, 13)), "int", L.season_of_month(F.col("x"))) == [
        "Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer", "Fall", "Fall", "Fall", "Winter"]
    days = [0.0, 1.0, 1.0001, 3.0, 7.0, 30.0, 30.5, None]
    assert column(spark, days, "double", L.duration_bucket(F.col("x"))) == [
        "<1 day", "<1 day", "1-3 days", "1-3 days", "3-7 days", "7-30 days", "30+ days", None]


def test_lifecycle_flags(spark):
    d = datetime
    rows = [("a", d(2025, 1, 1), d(2025, 1, 2, 12), "Closed"), ("b", d(2025, 1, 2), d(2025, 1, 1), "Open"),
            ("c", d(2025, 1, 1), None, "Closed"), ("d", d(2025, 1, 1), None, "Open")]
    df = spark.createDataFrame(rows, "unique_key string, created_date timestamp_ntz, closed_date timestamp_ntz, status string")
    df = df.withColumns({"latitude": F.lit(40.7), "longitude": F.lit(None).cast("double"), "borough": F.lit(None).cast("string")})
    out = {r["unique_key"]: r for r in add_lifecycle(df).collect()}
    assert out["a"]["resolution_days"] == 1.5 and out["a"]["resolution_bucket"] == "1-3 days"
    assert out["b"]["negative_resolution_flag"] and out["b"]["resolution_hours"] is None and not out["b"]["resolved_with_valid_date"]
    assert out["c"]["closed_status_missing_date_flag"] and not out["c"]["negative_resolution_flag"]
    assert out["b"]["nonclosed_status_has_date_flag"] and not out["d"]["nonclosed_status_has_date_flag"]
    assert all(r["missing_coordinates_flag"] and r["missing_borough_flag"] for r in out.values())


def test_defaults_after_join(spark):
    df = spark.createDataFrame(
        [("k", None, None, "T", None, None, None, None)],
        "unique_key string, agency string, status string, complaint_type string, issue_family string, issue_subtype string, "
        "subtype_modeled_flag boolean, is_closed_status boolean")
    row = apply_defaults(df).first()
    assert (row["agency"], row["status"], row["issue_family"], row["issue_subtype"]) == ("Unknown", "Unknown", "T", "not_modeled")
    assert row["subtype_modeled_flag"] is False and row["is_closed_status"] is False and row["status_backlog_flag"] is True


def test_coordinates_inclusive(spark):
    df = spark.createDataFrame([(40.49, -74.28), (40.93, -73.68), (40.0, -74.0), (None, -74.0)], "a double, b double")
    assert [r[0] for r in df.select(L.valid_coordinate(F.col("a"), F.col("b"), DEFAULT_BOX)).collect()] == [True, True, False, False]


def test_labels_and_shares(spark):
    scope = Scope("2025-01-01", 2025, 2026)
    assert column(spark, [2025, 2026, 2024], "int", L.year_label(F.col("x"), scope)) == ["2025", "2026 YTD", "2024"]
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 4)], "a int, b int")
    assert [r[0] for r in df.select(M.share(F.col("a"), F.col("b"))).collect()] == [None, 0.25, None]
    assert [r[0] for r in df.select(M.per_10k(F.col("a"), F.col("b"))).collect()] == [None, 2500.0, None]


def test_mode_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "z"), (3, "z"), (3, "a")], "k int, x string")
    out = dict(df.groupBy("k").agg(M.first_mode("x")).collect())
    assert out == {1: "a", 2: "Unknown", 3: "z"}


def test_order_ranks(spark):
    df = spark.createDataFrame([("Fall",), ("Winter",), ("B-odd",), ("A-odd",), (None,)], "x string")
    assert [r[0] for r in df.orderBy(*M.order_by_rank("x", SEASON_ORDER)).collect()] == ["Winter", "Fall", "A-odd", "B-odd", None]


def test_normalize_text(spark):
    values = ["  Don't STOP!! ", "wear & tear / 3+4 - x", "aâ\u0080\u0093b", "!!!", "None", None, "tab\tand\nline"]
    assert column(spark, values, "string", normalize_text("x")) == [
        "don t stop", "wear & tear / 3+4 - x", "a-b", None, None, None, "tab and line"]


def test_join_texts(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), (None, None)], "d string, e string")
    assert [r[0] for r in df.select(join_texts(F.col("d"), F.col("e"))).collect()] == ["a | b", "a", "b", ""]
