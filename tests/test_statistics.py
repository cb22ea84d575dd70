import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reqlens.contracts import Scope
from reqlens.operators import collapsed, equity, filters, order_statistics as O, ranking as R, sampling, scorecards as S

RNG = np.random.default_rng(7)


def hot_frame(n=6000):
    """One group holds most rows, one is null, one has no measured value."""
    group = np.where(RNG.random(n) < 0.7, "hot", RNG.choice(["a", "b"], n))
    value = np.round(RNG.exponential(20, n), 4)
    frame = pd.DataFrame({"g": group, "v": value, "flag": RNG.random(n) < 0.3})
    frame.loc[:9, "g"] = None
    frame.loc[10:20, "g"] = "empty"
    frame.loc[10:20, "v"] = np.nan
    frame.loc[RNG.random(n) < 0.1, "v"] = np.nan
    return frame


def to_spark(spark, frame, schema):
    rows = [tuple(None if (v is None or v != v) else (v.item() if hasattr(v, "item") else v) for v in row)
            for row in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("width", [1 / 24, 5.0, 1e6])
def test_quantiles_equal_numpy(spark, width):
    frame = hot_frame()
    df = to_spark(spark, frame, "g string, v double, flag boolean").repartition(7)
    tallied = O.tally(df, ["g"], {"flagged": F.col("flag")}, F.col("v"), width)
    out = {r["g"]: r for r in O.summarize(tallied, ["g"], "n", ["flagged"], {"q50": 0.5, "q90": 0.9}).collect()}
    assert set(out) == {None, "hot", "a", "b", "empty"}
    for name, row in out.items():
        part = frame[frame["g"].isna()] if name is None else frame[frame["g"] == name]
        assert row["n"] == len(part) and row["flagged"] == int(part["flag"].sum())
        values = part["v"].dropna()
        for q, column in ((0.5, "q50"), (0.9, "q90")):
            if values.empty:
                assert row[column] is None
            else:
                assert row[column] == pytest.approx(values.quantile(q), abs=1e-9)


def test_quantiles_without_keys_and_rollup(spark):
    frame = hot_frame(2000)
    df = to_spark(spark, frame, "g string, v double, flag boolean")
    tallied = O.tally(df, ["g", "flag"], {}, F.col("v"))
    coarse = {r["g"]: r["q"] for r in O.summarize(tallied, ["g"], "n", [], {"q": 0.9}).collect()}
    assert coarse["hot"] == pytest.approx(frame.loc[frame["g"] == "hot", "v"].dropna().quantile(0.9))
    total = O.summarize(O.tally(df, [], {}, F.col("v")), [], "n", [], {"q": 0.25}).first()
    assert total["n"] == 2000 and total["q"] == pytest.approx(frame["v"].dropna().quantile(0.25))


def test_labels_are_counted_with_the_bins(spark):
    """Modes and distinct labels equal a plain count, with hot groups, ties, nulls and a label of many values."""
    frame = hot_frame()
    frame["many"] = [f"n{i % 2500:04d}" for i in range(len(frame))]
    frame["tie"] = np.where(np.arange(len(frame)) % 2 == 0, "b", "a")
    frame.loc[frame["g"] == "empty", ["tie"]] = None
    df = to_spark(spark, frame, "g string, v double, flag boolean, many string, tie string").repartition(5)
    tallied = O.tally(df, ["g"], {"flagged": F.col("flag")}, F.col("v"), labels={"many": F.col("many"), "tie": F.col("tie")})
    out = {r["g"]: r for r in O.leading_labels(
        tallied, ["g"], {"top_many": "many", "top_tie": "tie"}, {"n_many": "many", "n_tie": "tie"}).collect()}
    assert set(out) == {None, "hot", "a", "b", "empty"}
    for name, row in out.items():
        part = frame[frame["g"].isna()] if name is None else frame[frame["g"] == name]
        for label in ("many", "tie"):
            counts = part[label].dropna().value_counts()
            assert row[f"n_{label}"] == len(counts)
            assert row[f"top_{label}"] == (min(counts[counts == counts.max()].index) if len(counts) else None)
    sums = {r["g"]: r for r in O.summarize(tallied, ["g"], "n", ["flagged"], {"q": 0.5}).collect()}
    assert sums["hot"]["n"] == (frame["g"] == "hot").sum()
    assert sums["hot"]["q"] == pytest.approx(frame.loc[frame["g"] == "hot", "v"].dropna().quantile(0.5))
    whole = O.leading_labels(tallied, [], {"top": "tie"}, {"n": "many"}).first()
    counts = frame["tie"].value_counts()
    assert whole["n"] == 2500 and whole["top"] == min(counts[counts == counts.max()].index)
    nothing = O.tally(df.where("false"), ["g"], {}, labels={"tie": F.col("tie")})
    assert O.leading_labels(nothing, ["g"], {"top": "tie"}).count() == 0


def shuffled_rows(df):
    """Rows written by the shuffles of a plan that has run."""
    from pyspark.sql import SparkSession

    def nodes(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from nodes(plan.executedPlan())
        elif name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            yield from nodes(plan.plan())
        else:
            yield plan
            children = plan.children()
            for i in range(children.size()):
                yield from nodes(children.apply(i))

    assert SparkSession.getActiveSession() is not None
    df.collect()
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
    return sum(n.metrics().apply("shuffleRecordsWritten").value() for n in found)


def test_shuffled_rows_grow_with_bins_and_not_with_rows(spark):
    """One row per value would be thirty thousand; both passes stay at groups times bins and values of wanted bins."""
    def frame(n):
        return spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % n / n * 40).alias("v")).repartition(4)

    first, second = [], []
    for n in (3_000, 30_000):
        df = frame(n)
        tallied = O.tally(df, ["g"], {}, F.col("v"), bin_width=2.0)
        first.append(shuffled_rows(tallied.histogram) - n)  # the repartition itself
        wanted = O.summarize(tallied, ["g"], "n", [], {"q": 0.5})
        second.append(shuffled_rows(wanted) - n)
        values = df.where("g = 1").toPandas()["v"]
        assert {r["g"]: r["q"] for r in wanted.collect()}[1] == pytest.approx(values.quantile(0.5))
    assert first[0] <= 3 * 20 * 4 and first[1] <= 3 * 20 * 4
    assert second[1] < 30_000 / 5  # two bins of twenty hold the wanted places


def test_bins_whose_ends_settle_a_place_are_not_read_again(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 1.1), ("b", 1.2), ("c", 5.0), ("d", None)], "g string, v double")
    out = O.summarize(O.tally(df, ["g"], {}, F.col("v"), 10.0), ["g"], "n", [], {"q": 0.5})
    assert {r["g"]: r["q"] for r in out.collect()} == {"a": 1.0, "b": pytest.approx(1.15), "c": 5.0, "d": None}
    assert "Join" not in out._jdf.queryExecution().toString()


def test_many_wanted_bins_are_joined_by_a_shuffle(spark, monkeypatch):
    frame = hot_frame(2000)
    df = to_spark(spark, frame, "g string, v double, flag boolean")
    monkeypatch.setattr(O, "BROADCAST_BINS", 0)
    out = {r["g"]: r["q"] for r in O.grouped_quantiles(df, ["g"], "v", {"q": 0.9}, bin_width=50.0).collect()}
    assert out["hot"] == pytest.approx(frame.loc[frame["g"] == "hot", "v"].dropna().quantile(0.9))


def test_group_summary_all_unresolved_and_null_key(spark):
    rows = [("x", True, 2.0), ("x", True, 4.0), ("x", False, None), (None, False, None), (None, False, None)]
    df = spark.createDataFrame(rows, "k string, resolved_with_valid_date boolean, resolution_days double")
    df = df.withColumn("unresolved_flag", ~F.col("resolved_with_valid_date"))
    for name in set(S.OPERATIONS_COUNTS.values()) - set(df.columns):
        df = df.withColumn(name, F.lit(False))
    out = {r["k"]: r for r in S.group_summary(df, ["k"]).collect()}
    assert out["x"]["median_resolution_days"] == 3.0 and out["x"]["p90_resolution_days"] == pytest.approx(3.8)
    assert out[None]["complaints"] == 2 and out[None]["median_resolution_days"] is None and out[None]["unresolved_share"] == 1.0
    assert all(r["resolved_complaints"] + r["unresolved_complaints"] == r["complaints"] for r in out.values())
    quick = S.group_summary(df, ["k"], approx=True)
    assert quick.count() == 2 and quick.columns[0] == "k"


def test_uniform_sample_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("unique_key"))
    one = {r[0] for r in sampling.uniform_sample(df.repartition(1), 777).collect()}
    many = {r[0] for r in sampling.uniform_sample(df.repartition(9), 777).collect()}
    assert len(one) == 777 and one == many
    assert one == set(sorted(map(str, range(5000)), key=lambda k: (hashlib.md5(f"{k}:42".encode()).hexdigest(), k))[:777])
    assert sampling.uniform_sample(df, 9000).count() == 5000
    assert sampling.uniform_sample(df.where("false"), 10).count() == 0


@pytest.mark.parametrize("size", [100, 333, 999])
def test_stratified_sample_exact(spark, size):
    label = F.when(F.col("id") < 2990, "hot").when(F.col("id") < 2999, "rare").otherwise("single")
    df = spark.range(3000).select(F.col("id").cast("string").alias("unique_key"), label.alias("resolution_bucket"))
    out = sampling.stratified_sample(df, size).toPandas()
    assert len(out) == size and out["unique_key"].is_unique
    assert out["resolution_bucket"].value_counts()["hot"] >= size - 12
    assert sampling.stratified_sample(df, 3000).count() == 3000


def test_row_weighted_quintiles_equal_qcut(spark):
    n = 1003
    areas = np.where(RNG.random(n) < 0.45, 0, RNG.integers(1, 15, n))
    value = {a: float(v) for a, v in enumerate(RNG.permutation(15) // 2)}
    frame = pd.DataFrame({"unique_key": np.arange(n) * 11, "zcta": [f"{a:05d}" for a in areas], "m": [value[a] for a in areas]})
    frame.loc[frame["zcta"] == "00014", "m"] = np.nan
    df = to_spark(spark, frame.assign(unique_key=frame["unique_key"].astype(str)), "unique_key string, zcta string, m double")
    quintiles = {"quint": ("m", "m")}
    got = equity.request_quintiles(df, quintiles).select(F.col("unique_key").cast("int").alias("k"), "quint").toPandas().set_index("k")["quint"]
    ranked = frame.dropna(subset=["m"]).sort_values(["m", "zcta", "unique_key"])
    ranked["rank"] = np.arange(1, len(ranked) + 1)
    expected = pd.Series(pd.qcut(ranked["rank"], 5, labels=equity.quintile_labels("m")).astype(str).to_numpy(), index=ranked["unique_key"])
    assert (got.loc[expected.index] == expected).all()
    assert got.drop(expected.index).isna().all()
    sizes = got.value_counts()
    assert sizes.max() - sizes.min() <= 1
    first = dict(equity.area_quintiles(df, quintiles).collect())
    for zcta, part in ranked.groupby("zcta"):
        assert first[zcta] == expected.loc[part.sort_values("rank")["unique_key"].iloc[0]]


KEYS = {
    "text": [f"req-{i}" for i in range(400)],
    "clustered": [str(10 ** 17 + i) for i in range(390)] + [str(-(2 ** 63)), str(2 ** 63 - 1), "0"],
    "mixed": [str(i) for i in range(100)] + [f"x{i}" for i in range(100)] + [None] * 150 + ["7"] * 100,
    "one key": ["5"] * 300,
}


def key_rank(key):
    """The stated order in plain Python: no key, integers by value, others by 60 bits of the md5 of their text."""
    if key is None:
        return -1, 0, ""
    try:
        return 0, int(key), key
    except ValueError:
        return 1, int(hashlib.md5(key.encode()).hexdigest()[:15], 16), key


@pytest.mark.parametrize("name", KEYS)
def test_keys_at_positions(spark, name):
    keys = KEYS[name]
    shuffled = [keys[i] for i in RNG.permutation(len(keys))]
    df = spark.createDataFrame([("a", key) for key in shuffled] + [("b", key) for key in shuffled[:50]] + [("c", "1")], "zcta string, unique_key string").repartition(3)
    wanted = [("a", 1), ("a", 2), ("a", 77), ("a", 200), ("a", len(keys)), ("b", 25)]
    positions = spark.createDataFrame(wanted, "zcta string, position bigint")
    ranked = {"a": sorted(keys, key=key_rank), "b": sorted(shuffled[:50], key=key_rank)}
    for options in ({}, {"bins": 8, "small": 10}):
        found = {(r["zcta"], r["position"]): r["cut"]["key"] for r in O.smallest_keys(df, "zcta", "unique_key", positions, **options).collect()}
        assert found == {(area, place): ranked[area][place - 1] for area, place in wanted}


def test_quintiles_of_text_keys(spark):
    """One area holds most rows; its requests, with keys that are no numbers, are dealt over the quintiles."""
    rows = [(f"r{i}", f"{min(i // 10, 5):05d}", float(min(i // 10, 5))) for i in range(500)]
    df = spark.createDataFrame(rows, "unique_key string, zcta string, m double")
    out = equity.request_quintiles(df, {"quint": ("m", "m")}).toPandas()
    ranked = sorted(rows, key=lambda r: (r[2], r[1], key_rank(r[0])))
    expected = pd.Series(pd.qcut(np.arange(500), 5, labels=equity.quintile_labels("m")).astype(str), index=[r[0] for r in ranked])
    got = out.set_index("unique_key")["quint"]
    assert (got.loc[expected.index] == expected).all()


def test_quintiles_need_five_values(spark):
    df = spark.createDataFrame([(str(i), f"{i % 4:05d}", float(i % 4)) for i in range(40)], "unique_key string, zcta string, m double")
    out = equity.request_quintiles(df, {"quint": ("m", "m")})
    assert out.where("quint IS NOT NULL").count() == 0 and out.count() == 40


def ytd_frame(spark, rows):
    return spark.createDataFrame(rows, "unique_key string, ts string").select(
        "unique_key", F.col("ts").cast("timestamp_ntz").alias("created_date")).withColumn("created_year", F.year("created_date"))


def test_aligned_ytd_floors_to_midnight(spark):
    scope = Scope("2025-01-01", 2025, 2026)
    df = ytd_frame(spark, [("a", "2025-03-10 00:00:00"), ("b", "2025-03-10 08:00:00"), ("c", "2026-03-10 09:00:00"),
                           ("d", "2026-03-09 23:00:00"), ("e", "2025-12-01 00:00:00"), ("f", "2024-01-01 00:00:00")])
    assert {r[0] for r in filters.filter_aligned_ytd(df, scope).select("unique_key").collect()} == {"a", "d"}
    assert {r[0] for r in filters.filter_aligned_exact(df, scope).select("unique_key").collect()} == {"a", "b", "c", "d"}
    base_only = df.where("created_year <> 2026")
    assert {r[0] for r in filters.filter_aligned_ytd(base_only, scope).select("unique_key").collect()} == {"a", "b", "e"}


def test_aligned_ytd_leap_day(spark):
    scope = Scope("2023-01-01", 2023, 2024)
    df = ytd_frame(spark, [("a", "2023-02-28 00:00:00"), ("b", "2024-02-29 10:00:00"), ("c", "2023-03-01 00:00:00")])
    assert {r[0] for r in filters.filter_aligned_ytd(df, scope).select("unique_key").collect()} == {"a"}


def test_complete_months_wraps_in_january(spark):
    monthly = spark.createDataFrame([("2025-01-01", "2026-01-20"), ("2025-12-01", "2026-01-20")], "m string, c string").select(
        F.col("m").cast("timestamp_ntz").alias("created_month_start"), F.col("c").cast("timestamp_ntz").alias("aligned_ytd_cutoff"))
    assert filters.aligned_complete_months(monthly).count() == 2
    assert filters.aligned_complete_months(monthly.withColumn("aligned_ytd_cutoff", F.lit("2026-03-02").cast("timestamp_ntz"))).count() == 1
    assert filters.aligned_complete_months(monthly.withColumn("aligned_ytd_cutoff", F.lit(None).cast("timestamp_ntz"))).count() == 2


def test_average_rank_and_winsor(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0), ("d", None)], "k string, v double")
    assert {r["k"]: r["average_rank"] for r in R.average_rank(df, "v").collect()} == {"a": 1.5, "b": 1.5, "c": 3.0, "d": None}
    flat = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", None)], "k string, v double")
    assert {r["k"]: r["s"] for r in R.winsor_scale(flat, "v", "s").collect()} == {"a": 0.5, "b": 0.5, "c": 0.5}
    scaled = {r["k"]: r["s"] for r in R.winsor_scale(df, "v", "s", reverse=True).collect()}
    assert scaled["a"] == 0.0 and scaled["c"] == 1.0 and scaled["d"] == 0.75


def test_pivot_reindex_and_domain(spark):
    df = spark.createDataFrame([("Mon", 1, 5), ("Tue", 2, 7)], "d string, h int, n int")
    wide = R.reindex(R.pivot_wide(df, "d", "h", {1: "h1", 2: "h2"}, "n"), "d", ["Tue", "Wed", "Mon"])
    assert [tuple(r) for r in wide.collect()] == [("Tue", None, 7), ("Wed", None, None), ("Mon", 5, None)]
    counts = dict(R.fixed_domain_counts(df, "h", [1, 3]).collect())
    assert counts == {1: 1, 3: 0}
    assert [tuple(r) for r in R.ordered(df.unionByName(spark.createDataFrame([(None, None, 1)], df.schema)), ("h", "desc"), ("d", "asc")).select("h").collect()] == [(2,), (1,), (None,)]


def categorical_rows(n=1500):
    frame = pd.DataFrame({"a": RNG.choice(["p", "q", "r"], n), "b": RNG.choice(["x", "y"], n, p=[0.8, 0.2])})
    frame["c"] = frame["b"].map({"x": "one", "y": "two"})  # depends on b
    frame["y"] = (frame["a"] == "q") * 1.5 - (frame["b"] == "y") * 0.5 + RNG.normal(size=n)
    frame["hit"] = RNG.random(n) < 1 / (1 + np.exp(-(frame["y"] - 0.7)))
    return frame


def dummies(frame, features):
    columns = {f"{f}={v}": (frame[f] == v).astype(float) for f in features for v in sorted(frame[f].unique())[1:]}
    return np.column_stack([np.ones(len(frame)), *columns.values()]), list(columns)


def test_collapsed_models_equal_whole_rows(spark):
    frame = categorical_rows()
    df = to_spark(spark, frame, "a string, b string, c string, y double, hit boolean")
    results = []
    for parts in (1, 5):
        design = collapsed.collapse(df.repartition(parts), ["a", "b", "c"], {"total": F.col("y"), "squares": F.col("y") * F.col("y"),
                                                                             "positives": F.col("hit").cast("int")})
        assert design.rows.count() <= 6
        coefficients, fit, rows = collapsed.least_squares(design, "total", "squares")
        likely = collapsed.logistic(design, "positives", strength=2.0)
        results.append((coefficients, fit, likely, collapsed.area_under_curve(design, likely, "positives")))
    x, names = dummies(frame, ["a", "b", "c"])
    assert [f"{f}={v}" for f, v in design.names] == names and rows == len(frame)
    centred = x[:, 1:] - x[:, 1:].mean(axis=0)
    slopes = np.linalg.lstsq(centred, frame["y"] - frame["y"].mean(), rcond=None)[0]
    residual = frame["y"] - frame["y"].mean() - centred @ slopes
    for coefficients, fit, likely, area in results:
        assert coefficients[1:] == pytest.approx(slopes, abs=1e-8)
        assert fit == pytest.approx(1 - (residual ** 2).sum() / ((frame["y"] - frame["y"].mean()) ** 2).sum())
        # The gradient of the penalised log loss is zero.
        share = 1 / (1 + np.exp(-x @ likely))
        slope = x.T @ (share - frame["hit"]) + np.append(0, likely[1:] / 2.0)
        assert np.abs(slope).max() < 1e-6
        score = x @ likely
        wins = (np.round(score[frame["hit"]].to_numpy() if hasattr(score, "to_numpy") else score[frame["hit"].to_numpy()], 9)[:, None]
                - np.round(score[~frame["hit"].to_numpy()], 9)[None, :])
        assert area == pytest.approx(((wins > 0) + 0.5 * (wins == 0)).mean())


def test_collapsed_models_of_empty_and_constant_rows(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 1.0)], "a string, y double")
    sums = {"total": F.col("y"), "squares": F.col("y") * F.col("y"), "positives": F.lit(1)}
    design = collapsed.collapse(df, ["a"], sums)
    coefficients, fit, rows = collapsed.least_squares(design, "total", "squares")
    assert coefficients.tolist() == [1.0] and np.isnan(fit) and rows == 2
    none = collapsed.collapse(df.limit(0), ["a"], sums)
    assert collapsed.least_squares(none, "total", "squares")[2] == 0 and collapsed.logistic(none, "positives").tolist() == [0.0]


def test_pairs_of_levels_are_added_up_in_arrays(spark):
    frame = categorical_rows(400)
    df = to_spark(spark, frame, "a string, b string, c string, y double, hit boolean").repartition(3)
    design = collapsed.collapse(df, ["a", "b", "c"], {"total": F.col("y")})
    sums = collapsed.cross_sums(design, F.col(collapsed.ROWS), F.col("total"))
    assert "Generate" not in sums._jdf.queryExecution().optimizedPlan().toString()  # no row per folded row and pair
    x, _ = dummies(frame, ["a", "b", "c"])
    weights, responses = x.T @ x, x.T @ (x * frame["y"].to_numpy()[:, None])
    found = {(r["left"], r["right"]): r for r in sums.collect()}
    assert set(found) == {(i, j) for i in range(len(weights)) for j in range(i, len(weights)) if weights[i, j]}
    for (i, j), row in found.items():
        assert row["weight"] == weights[i, j] and row["response"] == pytest.approx(responses[i, j])


def test_models_of_different_rows_are_folded_in_one_pass(spark):
    rows = [("p", True, 1.0), ("p", None, 2.0), ("q", True, 4.0), ("q", True, None), ("r", False, 8.0), (None, True, 3.0), ("p", True, 5.0)]
    df = spark.createDataFrame(rows, "a string, hit boolean, y double").where("a is not null")
    parts = {"one": (F.col("hit") & F.col("y").isNotNull(), {"total": F.col("y")}), "two": (F.col("hit").isNotNull(), {"positives": F.col("hit").cast("int")})}
    made = collapsed.collapse_parts(df, ["a"], parts)
    for name, (kept, sums) in parts.items():
        alone = collapsed.collapse(df.where(kept), ["a"], sums)
        columns = ["a", collapsed.ROWS, *sums, "_terms"]
        assert made[name].names == alone.names
        assert sorted(made[name].rows.select(*columns).collect()) == sorted(alone.rows.select(*columns).collect())


def test_quantiles_in_widening_bins_equal_numpy(spark):
    frame = hot_frame()
    frame["v"] = frame["v"] * np.where(np.arange(len(frame)) % 5 == 0, 100.0, 1.0) - np.where(np.arange(len(frame)) % 7 == 0, 3.0, 0.0)
    df = to_spark(spark, frame, "g string, v double, flag boolean")
    binned = df.where("v is not null").select("v", O.widening_bins(F.col("v")).alias("bin")).toPandas().sort_values("v")
    assert binned["bin"].is_monotonic_increasing and binned["v"].min() < 0
    out = {r["g"]: r["q"] for r in O.grouped_quantiles(df, ["g"], "v", {"q": 0.9}, bin_width=None).collect()}
    for name in ("hot", "a", "b"):
        assert out[name] == pytest.approx(frame.loc[frame["g"] == name, "v"].dropna().quantile(0.9), abs=1e-9)


def test_requests_are_counted_before_they_are_spread_over_the_levels(spark, monkeypatch):
    rows = [("z1", "A", "p", "s1", True, True, 1.0 + i) for i in range(9)] + [("z1", "A", "p", "not_modeled", False, True, 50.0), ("z2", "A", "q", "s2", True, False, None),
            ("z2", None, "q", "s2", True, True, 2.0), ("z2", "A", None, None, True, True, 3.0), ("z2", "A", "p", "s1", True, True, 900.0)]
    df = spark.createDataFrame(rows, "zcta string, agency string, complaint_type string, issue_subtype string, subtype_modeled_flag boolean, "
                               "resolved_with_valid_date boolean, resolution_days double").withColumns({"issue_family": F.col("complaint_type"), **{
                                   flag: F.lit(False) for flag in ("unresolved_flag", "status_backlog_flag", "potential_label_mismatch_flag")}})
    given = []
    spread = S.by_issue_level
    monkeypatch.setattr(S, "by_issue_level", lambda rows, levels: given.append(rows.columns) or spread(rows, levels))
    keys = ["issue_level", "zcta", "issue_value", "agency"]
    made = S.against_benchmark(df, keys, keys[:1] + keys[2:], S.EQUITY_COUNTS, "benchmark", "volume_share").collect()
    assert O.ROWS in given[0]
    levels = spread(df, ["complaint_type", "issue_family", "issue_subtype"]).toPandas()
    assert len(made) == len(levels.groupby(keys, dropna=False))
    for row in made:
        cell = levels[np.logical_and.reduce([levels[k].isna() if row[k] is None else levels[k] == row[k] for k in keys])]
        whole = levels[np.logical_and.reduce([levels[k].isna() if row[k] is None else levels[k] == row[k] for k in keys if k != "zcta"])]
        assert (row["complaints"], row["benchmark_complaints"]) == (len(cell), len(whole))
        for part, name in ((cell, "median_resolution_days"), (whole, "benchmark_median_resolution_days")):
            days = part.loc[part["resolved_with_valid_date"], "resolution_days"].dropna()
            assert row[name] == (None if days.empty else pytest.approx(days.median()))
