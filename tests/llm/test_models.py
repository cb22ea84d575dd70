"""Classifiers by held-out accuracy, neighbours by recall, the URL trie by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.llm import neighbours, quality, queries, toxicity, urlfilter

SF = "/root/testdata/sf0.01"


def held_out(spark, result, label, folder=SF):
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    return result.filter("held_out").join(labels, "doc_id").filter("label is not null").toPandas()


def test_quality_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    result = quality.score_documents(documents, labels)
    rows = held_out(spark, result, "quality")
    assert (rows.predicted == rows.label).mean() > 0.95
    assert rows[rows.label == 1].predicted.mean() > 0.97
    assert result.count() == documents.count() and result.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"  # the smaller tables hold some thirty toxic texts to learn from
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = held_out(spark, toxicity.score_documents(documents, labels), "toxic", folder)
    assert rows[rows.label == 0].predicted.mean() < 0.02
    assert rows[rows.label == 1].predicted.mean() > 0.7


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = [(i, "text", i % 2) for i in range(200)] + [(None, "text", 1)]
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    import zlib
    ids = {r["doc_id"] for r in quality.labelled_texts(documents, labels, "quality", 4, 2, 10_000).collect()}
    assert ids == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert quality.labelled_texts(documents, labels, "quality", 4, 2, 5).count() == 10


def test_scores_do_not_depend_on_the_bound_of_the_sample(spark):
    import zlib
    rows = [(i, int(i % 20 > 2)) for i in range(400)]
    documents = spark.createDataFrame([(i, "plain words here") for i, _ in rows] + [(1000, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
    fold = [q for i, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    share = sum(fold) / len(fold)
    # Ten rows of each class, all of them among the neighbours of every text.
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(documents, labels, rows=10).filter("doc_id in (1, 1000)").collect()}
    assert abs(scores[1] - share) < 1e-6 and abs(scores[1000] - share) < 1e-6


def test_quality_votes_equal_a_plain_version(spark):
    """Every document: cosines one by one, sorted; the first neighbours vote. The space is that of a plain decomposition."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality.score_documents(documents, labels, rows=100).select("doc_id", "score").toPandas().groupby("doc_id")["score"].first()
    model = quality.fit(documents, labels, rows=100)
    examples, targets = quality.collect_terms(quality.labelled_texts(documents, labels, "quality", 4, 2, 100))
    size = len(model.idf)

    def dense(keys, values):
        out = np.zeros(size)
        out[keys] = values
        return out

    matrix = np.stack([dense(*row) for row in examples])
    idf = np.log((1 + len(matrix)) / (1 + (matrix != 0).sum(axis=0))) + 0.2
    right = np.linalg.svd(matrix * idf, full_matrices=False)[2][:quality.DIMENSIONS]
    assert np.linalg.svd(right @ model.basis)[1].min() > 0.999  # both span one space
    per_class = np.array([1.0, 1.0])
    known = quality.known_labels(labels, "quality", 4, 2).toPandas().target
    for target in (0, 1):
        per_class[target] = max(1.0, (known == target).sum() / 100)

    def place(row):
        out = right @ (dense(*row) * idf)
        return out / np.linalg.norm(out) if np.linalg.norm(out) else out

    labelled = [(place(row), target) for row, target in zip(examples, targets)]
    terms, compared = quality.Terms(), 0
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toPandas().drop_duplicates("doc_id")
    for doc_id, text in zip(texts.doc_id, texts.text):
        own = place(terms.of(text))
        ranked = sorted(((float(own @ vector), target) for vector, target in labelled), reverse=True)
        k = quality.NEIGHBOURS
        edge = {target for cosine, target in ranked if abs(cosine - ranked[k - 1][0]) < 1e-5}
        if len(edge) > 1:
            continue  # labels of equally near texts at the last place differ: either may vote
        votes = [(max(cosine, 0.0) ** 4 * per_class[int(target)], target) for cosine, target in ranked[:k]]
        total = sum(weight for weight, _ in votes)
        wanted = sum(weight * target for weight, target in votes) / total if total else model.base_rate
        assert abs(scores[doc_id] - wanted) < 1e-3
        compared += 1
    assert compared > 0.9 * len(texts)


def test_scores_of_odd_rows(spark):
    documents = spark.createDataFrame([(1, ""), (2, None), (None, "words"), (3, "word " * 30_000), (3, "again")], "doc_id bigint, text string").withColumn("score", F.lit("x"))
    for score, label in ((quality.score_documents, "quality"), (toxicity.score_documents, "toxic")):
        none = spark.createDataFrame([], f"doc_id bigint, {label} int")
        some = spark.createDataFrame([(1, 1), (3, 0), (9, None), (None, 1), (3, 1)], f"doc_id bigint, {label} int")
        for labels in (none, some):
            result = score(documents, labels).collect()
            assert len(result) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in result)
            assert [r["held_out"] for r in result if r["doc_id"] is None] == [None]
        assert score(documents.limit(0), some).count() == 0


def test_identity_terms_lose_their_weight(spark):
    """Group names that stand in toxic training texts by accident must not make neutral texts toxic."""
    rows = []
    for i in range(400):
        toxic = i % 2
        group = "muslims" if toxic and i % 5 else "teachers"
        rows.append((i, f"{group} are {'awful scum and vermin' if toxic else 'kind people with plans'} number{i % 7} said someone", toxic))
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id bigint, toxic int")
    neutral = ["muslims are kind people with plans"]
    score = lambda fairness: toxicity.fit(documents, labels, fairness=fairness)
    fair, plain = score(3.0), score(0.0)
    gap = lambda model: abs(float(np.diff(model.scores([neutral[0], neutral[0].replace("muslims", "christians")], toxicity.Features(model.wanted)))[0]))
    assert gap(fair) < gap(plain) / 2
    assert fair.scores(["awful scum and vermin"], toxicity.Features(fair.wanted))[0] > 0.7


def test_names_are_exchanged_one_at_a_time_within_sentences(spark):
    swap = toxicity.exchanges((("men", "women"), ("old", "young")))
    made = sorted((sorted(a), sorted(b)) for a, b in toxicity.counterfactuals("Men and women met. The old town!\nNothing here", swap))
    assert made == [(["and", "men", "met", "women"], ["and", "men", "met"]), (["and", "men", "met", "women"], ["and", "met", "women"]),
                    (["old", "the", "town"], ["the", "town", "young"])]
    frame = spark.createDataFrame([(1, "Men met. Men ate.\nMen!", 1), (2, "men slept. nothing", 0), (3, "", 0)], "doc_id bigint, text string, target int")
    texts, pairs = toxicity.collect_features(frame, (("men", "women"),))
    assert len(texts) == 3 and pairs["copies"].tolist() == [4]
    number = toxicity.Features()
    assert np.frombuffer(pairs["lost"][0], "<i4").tolist() == sorted(number.of({"men"}))
    assert np.frombuffer(pairs["gained"][0], "<i4").tolist() == sorted(number.of({"women"}))


def test_texts_that_name_both_groups_count(spark):
    """The penalty acts although every text holds both names of the group."""
    rows = [(i, f"{'muslims are scum and vermin' if i % 2 else 'muslims are kind'}. {'christians agree' if i % 2 == 0 or i % 10 == 1 else 'people agree'} number{i % 7}", i % 2)
            for i in range(400)]
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id bigint, toxic int")

    def gap(fairness):
        model = toxicity.fit(documents, labels, fairness=fairness, groups=(("muslims", "christians"),))
        return abs(float(np.diff(model.scores(["muslims agree", "christians agree"], toxicity.Features(model.wanted)))[0]))
    assert gap(3.0) < gap(0.0) / 2


def brute(ids, vectors, k):
    out = {}
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        distance[ids == q] = np.inf
        out[q] = ids[np.lexsort((ids, distance))[:k]]
    return out


def test_recall_of_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(3)
    found = neighbours.nearest(table, table.filter("vec_id % 100 = 0")).toPandas()
    rows = table.toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    wanted = brute(ids, vectors, 10)
    hits = sum(len(set(own) & set(found[found.query_id == q].vec_id)) for q, own in wanted.items())
    assert hits >= 0.9 * 10 * len(wanted)
    row = found.iloc[0]
    exact = np.sqrt(((vectors[ids == row.query_id][0] - vectors[ids == row.vec_id][0]) ** 2).sum())
    assert abs(row.score - exact) < 1e-12 and sorted(found[found.query_id == row.query_id]["rank"]) == list(range(1, 11))


@pytest.mark.parametrize("shape", [None, (25_000, 64), (4_000, 200)])
def test_collisions_filter_neighbours(spark, shape):
    if shape is None:
        rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
        vectors = np.stack(rows.embedding).astype(np.float64)
    else:
        vectors = np.random.default_rng(3).standard_normal(shape)
    ids = np.arange(len(vectors))
    asked = ids[::100][:50]
    size = vectors.shape[1]
    index = neighbours.SortedProjections(ids, vectors, neighbours.lines(size, max(size, neighbours.LEAST_PROJECTIONS), 17))
    found = index.search(asked, vectors[asked], 10)
    wanted = brute(ids, vectors, 10)
    hits = sum(len(set(wanted[q]) & set(own[0])) for q, own in zip(asked, found))
    assert hits >= 0.9 * 10 * len(asked)
    assert index.verified < (0.2 if shape is None else 0.1) * len(asked) * len(ids)


def test_collision_counts_as_expected():
    """The threshold lies where mean and deviation of measured counts at the radius put it; axes of a rotation are orthogonal."""
    random = np.random.default_rng(5)
    for size, projections in ((64, 64), (200, 64), (16, 64)):
        axes = neighbours.lines(size, projections, 17)
        first = axes[:, :min(size, projections)]
        assert np.allclose(first.T @ first, size * np.eye(first.shape[1]))
        apart = random.standard_normal((20_000, size))
        apart /= np.linalg.norm(apart, axis=1, keepdims=True)
        counts = (np.abs(apart @ axes) <= neighbours.WIDTH / 2).sum(axis=1)
        for deviations in (0.5, 2.5):
            measured = counts.mean() - deviations * counts.std()
            assert abs(neighbours.collision_threshold(size, projections, deviations=deviations) - measured) < 1


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, []), (2, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    found = neighbours.nearest(frame, frame.filter("vec_id % 100 = 0"), k=3).collect()
    own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 0)
    assert own == [(1, 1, 0.0), (2, 2, 0.0), (3, 2, 0.0)]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0
    few = frame.filter("vec_id in (0, 1)")
    assert [r["vec_id"] for r in neighbours.nearest(few, few.filter("vec_id = 0")).collect()] == [1]


URLS = ["https://a.example.org/es/1", "https://example.org/en/1", "http://EXAMPLE.org/en/12", "http://example.org/en/2", "http://xexample.org/es/", "https://x.com/fr/1?q=/de/",
        "https://x.com/de", "https://x.com/de/", "com://com/de/#x", "https://org", "https://org/", "https://a.org?x", "no scheme", None, "", "://", "http://x.com/fr/../de/",
        "http://x.com:80/de/", "http://" + "a." * 500 + "com/de/" + "x" * 5000, "http://.org/", "http://org./"]


def test_trie_equals_brute_force(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "again")], "page_id bigint, url string, host string")
    result = urlfilter.judge_urls(frame, queries.RULES).collect()
    assert len(result) == len(URLS) + 1
    for row in result:
        url = URLS[row["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = []
        for verdict, rule in queries.RULES:
            own, wanted = urlfilter.split_rule(rule)
            if (host == own or host.endswith("." + own)) and path.startswith(wanted):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=(0, None, "allow"))
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, best[1], best[2]), url
    assert urlfilter.judge_urls(frame.limit(0), queries.RULES).count() == 0


def test_more_specific_rules_win():
    trie = urlfilter.build_trie([("block", "com/"), ("allow", "a.com/x/"), ("block", "a.com/x/y"), ("allow", "a.com/x/y"), ("allow", "b.com")])
    assert urlfilter.longest_rule(trie, "z.a.com", "/x/yz") == ("a.com/x/y", "block")
    assert urlfilter.longest_rule(trie, "a.com", "/x/") == ("a.com/x/", "allow")
    assert urlfilter.longest_rule(trie, "b.com", "/q") == ("b.com", "allow")
    assert urlfilter.longest_rule(trie, "net", "/") is None
