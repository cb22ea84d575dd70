"""Joint K-means against a plain version of the same rules."""

from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqlens.operators import clustering, ngrams

RNG = np.random.default_rng(11)


def points(spark, sizes=(("A", 60, 5), ("B", 25, 3), ("C", 4, 2)), parts=3):
    rows = []
    for family, n, width in sizes:
        for i in range(n):
            keys = np.sort(RNG.choice(width, RNG.integers(1, width + 1), replace=False))
            numbers = RNG.random(len(keys)) + 0.1
            numbers /= np.sqrt((numbers ** 2).sum())
            rows.append((family, f"{family} text {i}", float(RNG.integers(1, 5)), bytearray(keys.astype("<i4").tobytes()), bytearray(numbers.astype("<f8").tobytes())))
    return rows, spark.createDataFrame(rows, clustering.POINTS).repartition(parts)


def dense(rows, family, width):
    own = [r for r in rows if r[0] == family]
    made = np.zeros((len(own), width))
    for i, (_, _, _, keys, numbers) in enumerate(own):
        made[i, np.frombuffer(bytes(keys), "<i4")] = np.frombuffer(bytes(numbers), "<f8")
    return [r[1] for r in own], np.array([r[2] for r in own]), made


def plain(names, weight, x, clusters, starts, seed, iterations=50):
    """Every start on its own, by loops; returns the best start's centres and all inertias."""
    results = []
    for start in range(starts):
        centres = []
        for step in range(clusters):
            rates = np.tile(weight[:, None], (1, starts))
            if centres:
                near = np.array([min(round(float(((p - c) ** 2).sum()), 9) for c in centres) for p in x])
                rates = rates * near[:, None]
            times = clustering.finishing_times(pd.Series(names), rates, seed, step)[:, start]
            centres.append(x[int(np.lexsort((names, times))[0])])
        centres, inertia = np.array(centres), None
        for _ in range(iterations):
            distance = np.array([[round(float(((p - c) ** 2).sum()), 9) for c in centres] for p in x])
            nearest = distance.argmin(axis=1)
            inertia = float(weight @ distance.min(axis=1))
            after = np.array([np.average(x[nearest == k], axis=0, weights=weight[nearest == k]) if (nearest == k).any() else centres[k]
                              for k in range(clusters)])
            if ((after - centres) ** 2).sum(axis=1).max() <= 1e-6:
                break
            centres = after
        results.append((inertia, centres))
    return results


def test_all_families_and_starts_equal_the_plain_version(spark):
    rows, frame = points(spark)
    sizes = {"A": (4, 5), "B": (2, 3), "C": (3, 2)}
    for family, (clusters, width) in sizes.items():
        # One family at a time has its own number of rounds, as the plain version.
        names, weight, x = dense(rows, family, width)
        wanted = plain(names, weight, x, clusters, 4, 42)
        first = clustering.first_centres(frame, {family: (clusters, width)}, 4, 42)
        _, inertia = clustering.one_round(frame, first)
        best = clustering.best_centres(frame, {family: (clusters, width)}, 4, 42)[family]
        distance = ((x[:, None, :] - best[None]) ** 2).sum(axis=2).min(axis=1)
        assert weight @ distance == pytest.approx(min(i for i, _ in wanted), abs=1e-4)
        assert inertia[family].min() >= weight @ distance - 1e-6
    together = clustering.best_centres(frame, sizes, 4, 42)
    assert {f: made.shape for f, made in together.items()} == {f: size for f, size in sizes.items()}


def test_a_round_is_the_weighted_mean(spark):
    rows, frame = points(spark, (("A", 30, 4),))
    names, weight, x = dense(rows, "A", 4)
    centres = {"A": np.array([[x[0], x[1]], [x[2], x[3]]])}
    after, inertia = clustering.one_round(frame, centres)
    for start in range(2):
        distance = np.round(((x[:, None, :] - centres["A"][start][None]) ** 2).sum(axis=2), 9)
        nearest = distance.argmin(axis=1)
        for k in range(2):
            assert after["A"][start, k] == pytest.approx(np.average(x[nearest == k], axis=0, weights=weight[nearest == k]))
        assert inertia["A"][start] == pytest.approx(weight @ distance.min(axis=1))


def test_starts_do_not_depend_on_partitions(spark):
    _, frame = points(spark, (("A", 40, 5),))
    one = clustering.first_centres(frame.repartition(1), {"A": (3, 5)}, 3, 7)["A"]
    many = clustering.first_centres(frame.repartition(6), {"A": (3, 5)}, 3, 7)["A"]
    assert (one == many).all() and not (one[0] == one[1]).all()


def test_clusters_of_odd_families(spark):
    rows = [("F", "same words here", "other_unclassified")] * 200 + [(None, "no family", "other_unclassified")] * 200
    rows += [("G", text, "other_unclassified") for text in ("red apple", "red apple", "", "green pear") for _ in range(50)] + [("G", None, "other_unclassified")]
    df = spark.createDataFrame(rows, "complaint_type string, text_clean string, issue_subtype string")
    assignments, profiles = ngrams.residual_clusters(df)
    found = {r["text_clean"]: r["residual_cluster"] for r in assignments.collect()}
    assert set(found) == {"red apple", "", "green pear"} and found["red apple"] != found["green pear"]
    assert sum(r["cluster_rows"] for r in profiles.collect()) == 200
    for part in ngrams.residual_clusters(df.limit(0)):
        assert part.count() == 0


def test_frequent_terms_are_exact_by_summary_and_by_count(spark):
    words = [f"w{i}" for i in range(400)]
    weight = 1 / np.arange(1, 401)
    texts = [" ".join(RNG.choice(words, 30, p=weight / weight.sum())) for _ in range(400)] + [None, "", "w1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    counts = {r["ngram"]: (r["count"], r["documents"]) for r in ngrams.term_counts(df, "t", []).collect()}
    wanted = sorted(((n, d) for n, d in counts.items() if d[1] >= 5), key=lambda p: (-p[1][0], p[0]))[:10]
    names, others = ngrams.frequent_candidates(ngrams._terms(df, "t", [], ngrams.TOKEN), 50, 1 << 14)
    assert len(names) == 50 and all(counts[n][0] <= others for n in counts if n not in names)
    for candidates, tracked in ((50, 1 << 14), (20, 32), (10, 1 << 14)):  # set apart by the bound; not; not
        found = ngrams.top_ngrams(df, "t", 10, 5, [], candidates=candidates, tracked=tracked)
        assert [(r["ngram"], r["count"]) for r in found.collect()] == [(n, d[0]) for n, d in wanted]
    assert ngrams.top_ngrams(df.limit(0), "t", 10, 5, []).count() == 0


def test_rounds_read_no_texts_and_leave_out_starts_that_stand_still(spark, monkeypatch):
    rows, frame = points(spark, (("A", 60, 5), ("B", 3, 2)))
    sizes, seen, whole = {"A": (4, 5), "B": (3, 2)}, [], clustering.one_round

    def watched(given, centres):
        seen.append((set(given.columns), {family: len(made) for family, made in centres.items()}))
        return whole(given, centres)

    monkeypatch.setattr(clustering, "one_round", watched)
    best = clustering.best_centres(frame, sizes, 6, 42)
    assert all("point" not in columns for columns, _ in seen)
    assert seen[0][1] == {"A": 6, "B": 6} and seen[-1][1].get("A", 0) < 6 and "B" not in seen[-1][1]
    centres = clustering.first_centres(frame, sizes, 6, 42)  # every start in every round
    for _ in range(len(seen)):
        centres, inertia = whole(frame, centres)
    for family in sizes:
        assert np.allclose(best[family], centres[family][int(np.argmin(np.round(inertia[family], 6)))], atol=1e-6)


def test_profiles_take_the_first_text_of_a_cluster_without_sorting_texts(spark):
    rows = [("G", text, "other_unclassified") for text in ("red apple", "red apple pie", "green pear", "green pear tart") for _ in range(40)]
    df = spark.createDataFrame(rows, "complaint_type string, text_clean string, issue_subtype string").repartition(4)
    _, profiles = ngrams.residual_clusters(df)
    found = {r["example_text"]: (r["cluster_rows"], r["cluster_share"]) for r in profiles.collect()}
    assert found == {"red apple": (80, 0.5), "green pear": (80, 0.5)}
    assert profiles.schema == ngrams.PROFILE_SCHEMA
    plan = profiles._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_clusters_are_attached_by_digests(spark):
    rows = [("G", "red apple", "other_unclassified"), ("G", "red apple", "matched"), ("H", "red apple", "other_unclassified"),
            ("G", None, "other_unclassified"), (None, "red apple", "other_unclassified"), ("G", "", "other_unclassified")]
    df = spark.createDataFrame(rows, "complaint_type string, text_clean string, issue_subtype string")
    found = spark.createDataFrame([("G", "red apple", 1, "red"), ("G", "", 0, "none"), ("G", "x", 2, "x")], ngrams.ASSIGNMENT_SCHEMA)
    out = ngrams.attach_clusters(df, found)
    assert out.columns == [*df.columns, "residual_cluster", "residual_cluster_label"]
    assert sorted(map(str, out.collect())) == sorted(map(str, [
        r for row in rows for r in [spark.createDataFrame([(*row, *({("G", "red apple"): (1, "red"), ("G", ""): (0, "none")}.get(row[:2], (None, None))
                                    if row[2] == "other_unclassified" else (None, None)))], out.schema).first()]]))
    plan = out.hint("merge").groupBy("residual_cluster_label").count()._jdf.queryExecution().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("_text_digest" in line for line in dealt) and not any("text_clean" in line for line in dealt)


TEXTS = ["alpha beta alpha gamma", "alpha beta", "beta alpha beta", "gamma delta", "delta gamma delta", "rare words here", "", "the alpha the beta", "one"]


@pytest.mark.parametrize("max_terms,pattern", [(3, ngrams.TOKEN), (5, ngrams.TOKEN), (50, ngrams.TOKEN), (4, r"(\w\w+ \w\w+|\w\w+)")])
def test_pruned_terms_are_the_leading_ones_of_all(spark, max_terms, pattern):
    rows = [(family, text, i % 3 + 1) for family in ("F", "G") for i, text in enumerate(TEXTS + [f"w{k} x{k}" for k in range(40)] * (family == "G"))]
    texts = spark.createDataFrame(rows, "complaint_type string, text_clean string, rows bigint").repartition(3)
    for least in (1, 2, 4):
        found = ngrams._leading_terms(texts, ["the"], pattern, least, max_terms)
        wanted = ngrams._vocabulary(ngrams.term_counts(texts, "text_clean", ["the"], F.col("rows"), ["complaint_type"], pattern), ["complaint_type"], least, max_terms)
        names = ["complaint_type", "ngram", "count", "documents"]
        assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, wanted.select(*names).collect()))


def test_bigrams_of_rare_words_are_not_counted(spark, monkeypatch):
    texts = spark.createDataFrame([("F", text, 2) for text in TEXTS], "complaint_type string, text_clean string, rows bigint")
    monkeypatch.setattr(ngrams, "term_counts", lambda *a, **k: pytest.fail("all terms were counted"))
    found = {r["ngram"]: (r["count"], r["documents"]) for r in ngrams._leading_terms(texts, ["the"], ngrams.TOKEN, 2, 4).collect()}
    assert found == {"alpha": (10, 8), "beta": (10, 8), "alpha beta": (8, 8), "delta": (6, 4)}


def test_long_texts_are_taken_apart_from_others(monkeypatch):
    monkeypatch.setattr(ngrams, "SLICE", 3)
    words = [["a", "b"], [], ["c"], ["d", "e", "f", "g"], ["h"]]
    batch = pa.RecordBatch.from_pydict({"family": ["F", "F", "G", "F", "F"], "rows": [1, 2, 3, 4, 5], "words": pa.array(words, pa.list_(pa.string()))})
    found = [(family, part.column("rows").to_pylist(), row.tolist(), own.to_pylist()) for family, part, row, own in ngrams._slices([batch])]
    assert found == [("F", [1, 2], [0, 0], ["a", "b"]), ("F", [4], [0] * 4, ["d", "e", "f", "g"]), ("F", [5], [0], ["h"]), ("G", [3], [0], ["c"])]


def test_vectors_equal_a_plain_version(spark):
    df = spark.createDataFrame([("F", text, "other_unclassified") for text in TEXTS for _ in range(2)], "complaint_type string, text_clean string, issue_subtype string")
    made = ngrams.family_vectors(df, min_rows=2, max_terms=6, min_documents=2, stop_words=["the"])
    terms = made.vocabulary["F"]
    split = {t: [w for w in t.split() if w != "the" and len(w) > 1] for t in TEXTS}
    counted = {t: Counter(term for term in [*words, *map(" ".join, pairwise(words))] if term in terms) for t, words in split.items()}
    documents = {term: sum(2 for c in counted.values() if term in c) for term in terms}
    for row in made.points.collect():
        values = {term: n * (np.log((1 + 2 * len(TEXTS)) / (1 + documents[term])) + 1) for term, n in counted[row["point"]].items()}
        length = np.sqrt(sum(v * v for v in values.values()))
        found = dict(zip(np.frombuffer(bytes(row["keys"]), "<i4").tolist(), np.frombuffer(bytes(row["numbers"]), "<f8").tolist()))
        assert row["weight"] == 2 and found == pytest.approx({terms.index(term): v / length for term, v in values.items()})
    assert made.points.count() == len(TEXTS)
