"""Importance resampling against plain counting; language identification by held-out rows and plain FTRL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reqlens.llm import langid, queries, resample

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features_of(words):
    return Counter(zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain(documents, target, percent=5, least=20):
    s, t = Counter(), Counter()
    own = []
    for doc_id, text in documents:
        words = words_of(text)
        own.append((doc_id, len(words), features_of(words)))
        s += own[-1][2]
    for text in target:
        t += features_of(words_of(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for doc_id, n, features in own:
        weight = sum(gain[b] * k for b, k in features.items())
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, sum(features.values()), weight, score, None, n])
    able = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for place, row in enumerate(able[:len(able) * percent // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def result_rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_equals_plain_counting_on_the_whole_table(spark):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]
    documents = [(r["doc_id"], r["text"]) for r in tables[0].collect()]
    wanted = plain(documents, [r["text"] for r in tables[1].collect()])
    result = queries.QUERIES["op13_importance_resampling"](spark, SF)
    assert result.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert result_rows(result) == wanted


def test_resampling_of_odd_rows(spark):
    draw = random.Random(1)
    rows = [(1, ""), (2, None), (None, "a b c " * 10), (3, "A-b_c 1é2 x Ü"), (3, "A-b_c 1é2 x Ü"), (4, "word " * 60_000), (5, "x" * 5000 + " y"),
            *((10 + i, " ".join(draw.choice(["red", "green", "blue", "über", "42"]) for _ in range(draw.randint(15, 40)))) for i in range(60)),
            *((200, "one two three four five " * 5) for _ in range(30))]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"weight": F.lit("x"), "rank": F.lit(0), "bucket": F.lit(1)})
    target = spark.createDataFrame([("red green",), (None,), ("Blue blue",)], "text string").withColumn("doc_id", F.lit(1))
    for percent in (5, 50, 100):
        mine = result_rows(resample.resample(documents.repartition(3), target, percent=percent))
        assert mine == plain(rows, ["red green", None, "Blue blue"], percent)
    none = target.limit(0)
    assert result_rows(resample.resample(documents, none)) == plain(rows, [])
    assert resample.resample(documents.limit(0), target).count() == 0


def test_pieces_lose_and_repeat_nothing():
    texts = ["", "a", " ", "A b", "x" * 50, "é ñ Ü", "a b c d e f g" * 10, "the cat the cat sat " * 30, ("y" * 70 + " ") * 4]
    for most in (1, 7, 60, 1 << 18):
        words, own = np.zeros(len(texts), dtype=int), [Counter() for _ in texts]
        for order, owner, slots, buckets, counts in resample.occurrences([t.encode() for t in texts], most):
            words += np.bincount(owner, minlength=len(texts)) * (order == 1)
            for document, bucket in zip(owner.tolist(), buckets[slots].tolist()):
                own[document][bucket] += 1
            assert counts.sum() == len(slots)
        assert [(n, c) for n, c in zip(words.tolist(), own)] == [(len(words_of(t)), features_of(words_of(t))) for t in texts], most


def test_hashes_checksums_and_slots():
    text = b"the quick brown fox jumps over the lazy dog " * 8
    ranges, draw = resample.Ranges(text), random.Random(2)
    starts = np.array([draw.randrange(len(text) - 80) for _ in range(400)])
    lengths = np.array([draw.randint(1, 80) for _ in range(400)])
    held = [text[s:s + n] for s, n in zip(starts.tolist(), lengths.tolist())]
    assert ranges.hashes(starts, lengths).tolist() == [xxhash.xxh64_intdigest(h) for h in held]
    assert ranges.checksums(starts, lengths).tolist() == [zlib.crc32(h) for h in held]
    slots, holders = ranges.intern(starts, lengths)
    assert [held[k] for k in holders[slots].tolist()] == held and len(holders) == len(set(held))


def test_equal_keys_are_told_apart_by_their_bytes(monkeypatch):
    """All keys alike: only the bytes decide."""
    text = b"aa ab aa b ab "
    ranges = resample.Ranges(text)
    monkeypatch.setattr(resample.Ranges, "hashes", lambda self, starts, lengths: np.zeros(len(starts), dtype=np.uint64))
    slots, holders = ranges.intern(np.array([0, 3, 6, 9, 11]), np.array([2, 2, 2, 1, 2]))
    assert slots[0] == slots[2] and slots[1] == slots[4] and len(set(slots.tolist())) == 3 == len(holders)


def test_languages_of_held_out_rows(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    result = queries.QUERIES["op12_language_id"](spark, SF)
    assert result.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = result.join(documents, "doc_id").toPandas()
    assert len(rows) == documents.count() and rows.score.between(0, 1).all()
    held = rows[rows.held_out & rows.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert set(rows.lang_pred) <= set(rows.lang.dropna()) | {"und"}
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    sure = held[held.score >= 0.9]
    assert (sure.lang_pred == sure.lang).mean() > 0.98


def test_the_held_out_fold_is_not_learned(spark):
    rows = [(i, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else ("aa", "bb")[i % 2], f"word{i} text") for i in range(90)]
    documents = spark.createDataFrame(rows + [(None, "null", "text"), (500, None, "text")], "doc_id bigint, lang string, text string")
    assert langid.fit(documents).languages == ["aa", "bb"]
    chosen, counts = langid.sample(documents, 3, 1, 5)
    assert {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} == {"aa": 5, "bb": 5}
    assert sum(counts.values()) == sum(r[1] != "xx" for r in rows)


def test_languages_of_odd_rows(spark):
    rows = [(1, "en", "the house and the garden"), (2, "en", "the river and the sea"), (3, "de", "das haus und der garten"), (5, "de", "der fluss und das meer"),
            (4, "de", None), (6, "fr", ""), (7, "fr", "12 34 !?"), (8, None, "漢字"), (9, None, "the " * 300_000), (9, None, "das"), (None, "en", "the"), (3, "de", "das haus und der garten")]
    documents = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumns({"score": F.lit("x"), "draw": F.lit(1)})
    result = langid.identify(documents).collect()
    assert len(result) == len(rows) and all(0 <= r["score"] <= 1 for r in result)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in result if r["doc_id"] in (4, 6, 7)} == dict.fromkeys((4, 6, 7), ("und", 0.0))
    assert all(r["held_out"] is None for r in result if r["doc_id"] is None)
    assert langid.identify(documents.limit(0)).count() == 0
    unlabelled = langid.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}


def test_counts_of_n_grams_over_block_bounds(monkeypatch):
    columns = np.arange(1 << langid.HASH_BITS)
    texts = ["Der Fluß, das MEER!", "a", "é", "漢字 und so weiter " * 9, "x  y\n\nz"]
    whole = [langid.hashed_counts(t, columns, len(columns)) for t in texts]
    monkeypatch.setattr(langid, "_BLOCK", 4)
    for text, counts in zip(texts, whole):
        assert (langid.hashed_counts(text, columns, len(columns)) == counts).all()
        points = re.sub(r"[^\w]|[\d_]", " ", text.lower()).split()
        signs = len(" ".join(points)) + 2
        assert counts.sum() == signs + signs - 1 + max(0, signs - 2)


def test_follow_the_leader_equals_a_plain_version():
    draw = np.random.default_rng(3)
    vectors = [(np.sort(draw.choice(6, 3, replace=False)), draw.random(3)) for _ in range(30)]
    targets, importance = draw.integers(0, 3, 30), draw.random(30) + 0.5
    got = langid.follow_the_leader(vectors, targets, importance, 6, 3, epochs=2, alpha=0.3, beta=0.7, l1=0.05, l2=0.2)
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]

    def weight(i, c):
        if abs(z[i][c]) <= 0.05:
            return 0.0
        return -(z[i][c] - math.copysign(0.05, z[i][c])) / ((0.7 + math.sqrt(n[i][c])) / 0.3 + 0.2)

    for _ in range(2):
        for (keys, values), target, w in zip(vectors, targets, importance):
            pairs = [*zip(keys.tolist(), values.tolist()), (6, 1.0)]
            margin = [sum(v * weight(i, c) for i, v in pairs) for c in range(3)]
            total = sum(math.exp(m) for m in margin)
            current = {(i, c): weight(i, c) for i, _ in pairs for c in range(3)}
            for i, v in pairs:
                for c in range(3):
                    g = v * (math.exp(margin[c]) / total - (c == target)) * w
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / 0.3
                    z[i][c] += g - sigma * current[i, c]
                    n[i][c] += g * g
    assert np.allclose(got, [[weight(i, c) for c in range(3)] for i in range(7)])
    assert (got == 0).any()


def test_temperature_has_the_least_log_loss():
    draw = np.random.default_rng(4)
    targets = draw.integers(0, 3, 200)
    margin = 8 * (draw.normal(size=(200, 3)) + np.eye(3)[targets])
    best = langid.calibrate(margin, targets, np.ones(200))
    losses = [langid.log_loss(margin, targets, np.ones(200), t) for t in (best, best * 0.9, best * 1.1, 1.0)]
    assert losses[0] == min(losses) and best > 2
    assert langid.calibrate(margin[:0], targets[:0], np.ones(0)) == 1.0


def test_the_draw_of_a_language_is_bounded_before_its_shuffle(spark):
    documents = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    chosen, counts = langid.sample(documents, 3, 1, 10)
    assert chosen.count() == 10 and counts["en"] > 13_000
