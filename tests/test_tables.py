import json

import pytest
from pyspark.sql import functions as F

from reqlens.contracts import RAW_COLUMNS, Scope
from reqlens.operators import geography as G
from reqlens.operators import ngrams, taxonomy as T
from reqlens.operators.frames import build_analytic
from reqlens.plans import stages
from reqlens.rules import OUTCOME_RULES, SUBTYPE_RULES, TARGET_FAMILIES, MismatchRule
from reqlens.sources import areas, bucketed, quoted, raw, tables


def test_names():
    assert raw.normalize_name(" Problem (formerly Complaint Type) ") == "problem_formerly_complaint_type"
    assert raw.normalize_name("X__Y--Z") == "x_y_z"


def test_csv_to_year_folders(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('Unique Key,Created Date,Agency Name\n1,01/02/2025 03:04:05 PM,"A ""x"", b"\n2,junk,B\n3,12/31/2026 11:00:00 AM,C\n')
    df = raw.read_raw(spark, str(path))
    assert df.columns == ["unique_key", "created_date", "agency_name"]
    assert df.where("unique_key = '1'").first()["agency_name"] == 'A "x", b'
    out = str(tmp_path / "years")
    raw.write_by_year(df, out)
    assert {p.name for p in (tmp_path / "years").iterdir() if p.is_dir()} == {"created_year=2025", "created_year=2026", "created_year=unknown"}
    years = raw.read_years(spark, out, [2025, 2026], ["unique_key", "created_date"])
    assert {tuple(r) for r in years.collect()} == {("1", "2025-01-02 15:04:05"), ("3", "2026-12-31 11:00:00")}
    assert "PartitionFilters: [cast(created_year" in years._jdf.queryExecution().toString() or "PartitionFilters: [" in years._jdf.queryExecution().toString()


def test_broken_lines_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "extract"
    folder.mkdir()
    text = ["Unique Key,Created Date,Odd `Name"]
    for i in range(60):
        remark = ["plain", '"two\nlines"', '"a ""b""\n\nc, d"', '""', "", '"' + "long\n" * 30 + '"', '"""x"""'][i % 7]
        text.append(f"{i},01/02/2025 03:04:05 PM,{remark}")
    (folder / "a.csv").write_text("\n".join(text) + "\n")
    (folder / "b.csv").write_text("\n\n".join([text[0], '100,junk,"end\n"']))
    (folder / "c.csv").write_bytes(b"Unique Key,Created Date,Odd `Name\r\n200,junk,x\r\n201,junk,\"y\"\r\n")
    plain = spark.read.option("header", True).options(**quoted.CSV).csv(str(folder)).collect()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        df = quoted.read_quoted_csv(spark, str(folder))
        assert df.columns == ["Unique Key", "Created Date", "Odd `Name"]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, plain), key=str) and len(plain) == 63
        dates = raw.read_raw(spark, str(folder), multi_line=True)
        assert dates.columns[0] == "unique_key" and dates.where("created_date = '2025-01-02 15:04:05'").count() == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_missing_inputs_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError) as error:
        tables.require_inputs(spark, [str(tmp_path / "no1"), str(tmp_path / "no2")])
    assert "no1" in str(error.value) and "no2" in str(error.value)
    path = tables.write_table(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="missing required columns: other"):
        tables.read_table(spark, path, ["id", "other"])
    written = tables.publish({"a": spark.range(2), "b": spark.range(5)}, str(tmp_path / "out"))
    assert spark.read.parquet(written["b"]).count() == 5
    target = tables.write_projection(spark, path, ["id"], str(tmp_path / "p"))
    assert spark.read.parquet(target).columns == ["id"]


def test_assemble(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "unique_key string, x int")
    b = spark.createDataFrame([("k", "y"), ("m", "z")], "unique_key string, w string")
    assert {tuple(r) for r in tables.assemble_columns([a, b], ["x", "w"]).collect()} == {(1, "y"), (3, "z")}
    with pytest.raises(ValueError, match="nowhere"):
        tables.assemble_columns([a, b], ["x", "nowhere"])
    with pytest.raises(ValueError, match="no common key"):
        tables.assemble_columns([a, b.drop("unique_key")], ["x", "w"])
    with pytest.raises(ValueError, match="not unique"):
        tables.assert_unique(a, "unique_key")
    tables.assert_unique(b, "unique_key")


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    keys = F.when(F.col("id") % 3 > 0, F.col("id").cast("string"))
    left = spark.range(900).select(keys.alias("unique_key"), F.col("id").alias("x"), F.lit("a'b").alias("odd `name"))
    right = spark.range(0, 900, 2).select(F.col("id").cast("string").alias("unique_key"), (F.col("id") * 2).alias("y"))
    paths = [bucketed.write_bucketed(df, str(tmp_path / name), buckets=6) for df, name in ((left, "it's left"), (right, "right"))]
    (keyed, keyless), (other, none) = (bucketed.read_bucketed(spark, path) for path in paths)
    assert keyed.count() == 600 and keyless.count() == 300 and none.count() == 0 and keyed.columns == left.columns
    # Rows without a key do not share one file.
    assert len(list((tmp_path / "it's left" / "_has_key=0").glob("*.parquet"))) > 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keyed.join(other, "unique_key", "left")
        gathered = tables.assemble_columns([keyed, other], ["unique_key", "x", "y"])
        plain = spark.read.parquet(paths[0]).join(spark.read.parquet(paths[1]), "unique_key")
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (joined, gathered, plain)]
        assert ["Exchange" in plan for plan in plans] == [False, False, True]
        assert joined.where("y = 2 * x").count() == 300 and joined.where("y IS NULL").count() == 300
        assert gathered.count() == 300
        bucketed.write_bucketed(right.limit(1), paths[1], buckets=3)
        again = bucketed.read_bucketed(spark, paths[1])[0]
        assert again.count() == 1 and keyed.join(again, "unique_key", "left").count() == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    empty = bucketed.write_bucketed(right.limit(0), str(tmp_path / "empty"), buckets=6)
    assert [side.count() for side in bucketed.read_bucketed(spark, empty)] == [0, 0]
    with pytest.raises(FileNotFoundError):
        bucketed.read_bucketed(spark, tables.write_table(right, str(tmp_path / "plain")))
    with pytest.raises(ValueError, match="missing required"):
        bucketed.write_bucketed(right, str(tmp_path / "x"), key="nowhere")


def test_array_table_and_demographics(spark, tmp_path):
    header = ["NAME", "B19013_001E", "B15003_022E", "B15003_023E", "B15003_024E", "B15003_025E", "B15003_001E",
              "B17001_001E", "B17001_002E", "B25003_001E", "B25003_003E", "B03002_001E", "B03002_003E", "B25064_001E", areas.AREA_COLUMN]
    rows = [header, ["A", "50", "1", None, "2", "x", "10", "4", "1", "0", "0", "8", "2", "-666666666", "501"],
            ["B", "x", None, None, None, None, "10", "4", "1", "5", "2", "8", "2", "9", "11215"]]
    path = tmp_path / "census.json"
    path.write_text(json.dumps(rows))
    table = areas.read_array_table(spark, str(path))
    out = {r["zcta"]: r for r in areas.demographic_columns(table).collect()}
    assert out["00501"]["bachelors_or_higher_count"] == 3.0 and out["00501"]["renter_share"] is None
    assert out["00501"]["poverty_share"] == 0.25 and out["00501"]["nonwhite_share"] == 0.75
    assert out["11215"]["bachelors_or_higher_count"] is None and out["11215"]["median_household_income"] is None
    assert out["00501"]["median_gross_rent"] == -666666666.0
    clean = areas.demographic_columns(table, null_sentinels=True).where("zcta = '00501'").first()
    assert clean["median_gross_rent"] is None


def test_rule_list_shape():
    assert list(SUBTYPE_RULES) == TARGET_FAMILIES
    assert [len(r) for r in SUBTYPE_RULES.values()] == [12, 4, 4, 2, 2, 4, 15, 8, 21, 7, 5]
    assert len(OUTCOME_RULES) == 10


def label(spark, rows):
    df = spark.createDataFrame(rows, "unique_key string, complaint_type string, descriptor string, additional_details string")
    out = T.flag_label_mismatches(T.assign_subtypes(T.add_normalized_text(T.clean_taxonomy_input(df))))
    return {r["unique_key"]: r for r in out.collect()}


def test_first_rule_wins_and_anchors(spark):
    out = label(spark, [
        ("1", "Illegal Parking", "Blocked Hydrant no parking", None), ("2", "HEAT/HOT WATER", "ENTIRE", "NO HEAT"),
        ("3", "HEAT/HOT WATER", "ENTIRE", "NO HEAT AND NO HOT WATER"), ("4", "PLUMBING", "RADIATOR", "MISSING OR REMOVED"),
        ("5", "Illegal Parking", "Loud Talking", None), ("6", "Graffiti", "Pothole", None), ("7", "Illegal Parking", "zzz", "Fire Hydrant")])
    assert [out[k]["issue_subtype"] for k in "1234567"] == [
        "blocked_hydrant", "no_heat", "no_heat_no_hot_water", "radiator_missing_or_removed", "other_unclassified", "not_modeled", "blocked_hydrant"]
    assert out["5"]["potential_label_mismatch_flag"] and out["5"]["mismatch_suspected_family"] == "Noise" and out["5"]["mismatch_match_text"] == "Loud Talking"
    assert out["6"]["issue_subtype_confidence"] == "not_modeled" and out["6"]["subtype_match_text"] is None
    assert out["4"]["subtype_match_text"] == "RADIATOR" and out["2"]["subtype_match_text"] == "NO HEAT"
    assert not any(out[k]["potential_label_mismatch_flag"] for k in "123467")


def test_empty_rules(spark):
    df = spark.createDataFrame([("1", "T", "d", None)], "unique_key string, complaint_type string, descriptor string, additional_details string")
    out = T.flag_label_mismatches(T.assign_subtypes(T.add_normalized_text(df), {"T": []}), []).first()
    assert out["issue_subtype"] == "other_unclassified" and out["potential_label_mismatch_flag"] is False


def test_outcomes(spark):
    df = spark.createDataFrame([("1", "Police issued a summons and no violation existed"), ("2", "?!"), ("3", "send an email today")], "unique_key string, resolution_description string")
    out = {r["unique_key"]: r for r in T.classify_outcomes(df).collect()}
    assert (out["1"]["resolution_outcome_group"], out["1"]["resolution_outcome_confidence"]) == ("summons_issued", "high")
    assert (out["2"]["resolution_outcome_group"], out["2"]["resolution_text_length"]) == ("other_resolution_language", 0)
    assert out["3"]["resolution_outcome_group"] == "external_status_or_referral"
    joined = T.attach_outcomes(spark.createDataFrame([("1",), ("9",)], "unique_key string"), df)
    missing = joined.where("unique_key = '9'").first()
    assert missing["resolution_outcome_group"] == "no_resolution_text" and missing["resolution_has_text"] is False


def test_ngrams(spark):
    df = spark.createDataFrame([("the cat sat on the mat",), ("Cat sat; cat",), (None,)], "t string")
    counts = {r["ngram"]: (r["count"], r["documents"]) for r in ngrams.term_counts(df, "t", ["the", "on"]).collect()}
    assert counts == {"cat": (3, 2), "sat": (2, 2), "mat": (1, 1), "cat sat": (2, 2), "sat mat": (1, 1), "sat cat": (1, 1)}
    assert [r["ngram"] for r in ngrams.top_ngrams(df, "t", 2, 2, ["the", "on"]).collect()] == ["cat", "cat sat"]


def test_residual_clusters(spark):
    texts = ["broken street light pole", "dead animal on road", "tree branch fallen road"]
    rows = [("F", texts[i % 3], "other_unclassified") for i in range(240)] + [("G", "same text", "other_unclassified")] * 300 + [("H", "x y", "other_unclassified")] * 10
    df = spark.createDataFrame(rows, "complaint_type string, text_clean string, issue_subtype string")
    assignments, profiles = ngrams.residual_clusters(df)
    out = profiles.collect()
    assert {r["complaint_type"] for r in out} == {"F"} and sum(r["cluster_rows"] for r in out) == 240
    assert sum(r["cluster_share"] for r in out) == pytest.approx(1.0) and len(out) <= 2
    attached = ngrams.attach_clusters(df, assignments)
    assert attached.count() == len(rows) and attached.where("residual_cluster IS NOT NULL").count() == 240


def test_grid_geometry_and_bins(spark):
    df = spark.createDataFrame([("1", -74.275, 40.495, True, True), ("2", -74.275, 40.495, True, False), ("3", 0.0, 0.0, False, False)],
                               "unique_key string, longitude double, latitude double, valid_coordinate_flag boolean, unresolved_flag boolean")
    df = df.withColumn("created_month_start", F.lit("2025-01-01").cast("timestamp_ntz"))
    cell = G.grid_persistence(G.grid_monthly(df)).first()
    assert cell["grid_id"] == "0:0" and cell["total_complaints"] == 2 and cell["hotspot_month_share"] == 1.0
    assert cell["geometry_wkt"].startswith("POLYGON ((-74.27 40.49, -74.27 40.5, -74.28 40.5, -74.28 40.49, -74.27")
    assert cell["latitude"] == pytest.approx(40.495)


def raw_rows(spark, n=60):
    df = spark.range(n)
    minutes = (F.col("id") * 9000).cast("int")
    created = F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 9000 as int))")
    return df.select(
        F.col("id").cast("string").alias("unique_key"), created.cast("string").alias("created_date"),
        (created + F.expr("make_dt_interval(cast(id % 40 as int))")).cast("string").alias("closed_date"),
        *[F.lit("x").alias(c) for c in RAW_COLUMNS if c not in ("unique_key", "created_date", "closed_date", "latitude", "longitude")],
        F.lit("40.7").alias("latitude"), F.lit("-74.0").alias("longitude"))


def test_stages_publish(spark, tmp_path):
    scope = Scope("2025-01-01", 2025, 2026)
    source = str(tmp_path / "raw")
    raw.write_by_year(raw_rows(spark, 80), source)
    analytic = stages.analytic_stage(spark, source, str(tmp_path / "out"), scope, buckets=4)
    assert analytic.count() == 80 and "_has_key" not in analytic.columns
    labels = stages.taxonomy_stage(analytic, None, cluster=False)
    beside = bucketed.write_bucketed(labels, str(tmp_path / "labels"), buckets=4)
    enriched = stages.frames.enrich_bucketed(spark, str(tmp_path / "out" / "analytic"), beside)
    plain = stages.frames.enrich(analytic, labels)
    assert enriched.exceptAll(plain.select(*enriched.columns)).count() == 0 and enriched.count() == 80
    paths = stages.publish_stage(stages.operations_stage(enriched, scope), str(tmp_path / "out"))
    agency = spark.read.parquet(paths["agency_metrics"]).first()
    assert agency["agency"] == "X" and agency["complaints"] == 80 and agency["top_modeled_subtype"] is None
    boards = spark.createDataFrame([("a", 1)], "top_issue_subtype string, n int")
    summary = stages.text_summaries(labels, boards, spark.read.parquet(paths["agency_metrics"]))
    assert len(summary) == 12 and summary["board_top_subtypes"].first()["boards"] == 1
    assert len(stages.exploratory_summaries(analytic, scope)) == 12
    monthly = stages.sort_table("operations_monthly", spark.read.parquet(paths["operations_monthly"]))
    months = [r["created_month_start"] for r in monthly.collect()]
    assert months == sorted(months)


def test_analytic_scope(spark):
    df = raw_rows(spark, 10).withColumn("created_date", F.when(F.col("unique_key") == "3", "junk").otherwise(F.col("created_date")))
    out = build_analytic(df, Scope("2025-01-10", 2025, 2026))
    assert out.where("created_date < timestamp_ntz'2025-01-10'").count() == 0 and out.where("unique_key = '3'").count() == 0
