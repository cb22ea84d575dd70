"""Near duplicates, decontamination, token files, pieces and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reqlens.llm import common, decontam, neardup, pieces, queries, tokenfiles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in texts], SCHEMA)


def components(texts):
    """All pairs, by the definition."""
    sets = {}
    for i, text in texts:
        words = neardup.words_of(text or "")
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return sets, root


def copies(seed, groups, size, words=90, edits=4):
    """Groups of texts with a few words exchanged."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, number = [], 0
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=words)
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(words)] = rnd.choice(vocabulary)
            texts.append((number, " ".join(own)))
            number += 1
    rnd.shuffle(texts)
    return texts


def test_near_duplicates_equal_all_pairs(spark):
    texts = copies(1, 6, 14) + [(900, "One two"), (901, "one  TWO"), (902, ""), (903, None), (904, " \t"), (905, "a a a a a a"), (906, "a a a a a"),
                                (907, "É x"), (908, "é x")]
    result = {r["doc_id"]: r for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    sets, root = components(texts)
    assert len(result) == len(texts)
    for i, _ in texts:
        row = result[i]
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[i]), root[i], root[i] == i)


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = copies(5, 1, 110, edits=9)
    result = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert result == components(texts)[1]


def test_near_duplicates_with_odd_rows(spark):
    frame = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "x y z")])
    result = neardup.near_duplicates(frame.withColumn("sketch", F.lit(1)).withColumn("node", F.lit(2))).collect()
    assert len(result) == 6
    assert all(r["component_id"] == 1 for r in result if r["doc_id"]) and all(r["kept"] and r["component_id"] is None for r in result if r["doc_id"] is None)
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    a, b = values[:1500], values[500:]
    assert (np.maximum(neardup.set_sketch(a), neardup.set_sketch(b)) == neardup.set_sketch(values)).all()
    share = (neardup.set_sketch(a) == neardup.set_sketch(b)).mean()
    assert abs(share - len(np.intersect1d(a, b)) / len(values)) < 0.13


def test_connected_on_a_path(spark):
    order = list(range(40))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (100, 101)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in neardup.connected(links, common.Scratch(spark, "test")).collect()}
    assert len({roots[k] for k in range(40)}) == 1 and roots[100] == roots[101] != roots[0]


BENCHMARK = [(1, "the quick brown fox jumps over the lazy dog while nobody watches it run"), (2, "we saw Alice and Bob and then Alice went home with two green bags"),
             (3, "add 12 apples to 30 pears and take 12 away again before lunch is served"), (4, "short one here"), (5, None), (None, "")]


@pytest.mark.parametrize("text, items", [
    ("so THE!! QUICK!! BROWN!! FOX!! JUMPS!! OVER!! THE!! LAZY!! DOG!! WHILE!! x", "1"), ("the quick brown fox jumps over the lazy cat", ""),
    ("we saw Dana and Erin and then Dana went home with two green bags", "2"), ("we saw Dana and Erin and then Erin went home with two green bags", ""),
    ("add 77 apples to 5,000.5 pears and take 77 away again before lunch", "3"), ("add 77 apples to 5 pears and take 78 away again", ""), ("add 77 apples to 5 pears and take 77 away again", "3"),
    ("a short one here too", "4"), ("", ""), (None, ""), ("short one", "")])
def test_template_windows(spark, text, items):
    benchmark = spark.createDataFrame(BENCHMARK + BENCHMARK[:1], "item_id bigint, text string")
    row = decontam.contamination(documents(spark, [(7, text)]), benchmark).collect()[0]
    assert (row["items"], row["contaminated"]) == (items, items != "")


DENSE = [(1, "Compute 12 + 15 * 7 - 3 / 4"), (2, "1 1 2 3 5 8 13 21 34 55 89 144"), (3, "row 3.5 4 km 7 8 km 9 row 10 11 12 13 14 sum"), (4, "42")]


def test_windows_of_many_placeholders_need_equal_values(spark):
    wanted = {"so: compute 12 + 15 * 7 - 3 / 4, please": "1", "compute 12 + 15 * 7 - 3 / 5": "", "see 0 1 1 2 3 5 8 13 21 34 55 89 here": "2",
              "1 1 2 3 5 8 13 21 34": "", "0 0 0 0 0 0 0 0 0 0 0 0": "", "Row 3.5 4 KM 7 8 km 9 row 10 and": "3", "row 3.5 4 km 7 8 km 9 row 1": "",
              "it is 42": "4", "it is 43": ""}
    benchmark = spark.createDataFrame(DENSE, "item_id bigint, text string")
    found = {r["doc_id"]: r["items"] for r in decontam.contamination(documents(spark, list(enumerate(wanted))), benchmark).collect()}
    assert [found[i] for i in range(len(wanted))] == list(wanted.values())


def test_names_begin_sentences_and_are_one_placeholder(spark):
    items = [(1, "Tom has 5 apples. Sue has 7 pears. Tom gives Sue 3."), (2, "Maria sells green lamps"), (3, "yesterday our neighbour John Smith went home and sang to the old cat"),
             (4, "The river was cold. Then Anna swam to the far bank alone.")]
    wanted = {"Ann has 8 apples. Bob has 6 pears. Ann gives Bob 4.": "1", "Ann has 8 apples. Bob has 6 pears. Bob gives Ann 4.": "", "so John Smith sells green lamps": "2",
              "Green lamps": "", "yesterday our neighbour Maria went home and sang to the old cat": "3", "The river was cold. Then Mary Ann O'Neil swam": "",
              "The river was cold. Then Mary Ann swam to the far bank": "4", "A river was cold. Then Mary Ann swam to the far": ""}
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {r["doc_id"]: r["items"] for r in decontam.contamination(documents(spark, list(enumerate(wanted))), benchmark).collect()}
    assert [found[i] for i in range(len(wanted))] == list(wanted.values())


def test_places_of_dense_windows(spark):
    rnd = random.Random(3)
    for size in (1, 3, 6, 10):
        texts = [[rnd.choice(["a", "0", "1", "b"]) for _ in range(rnd.randint(size, 40))] for _ in range(60)]
        frame = spark.createDataFrame([(t,) for t in texts], "w array<string>").select("w", decontam.dense_places("w", size).alias("p"))
        for r in frame.collect():
            assert sorted(r["p"]) == [i + 1 for i in range(len(r["w"]) - size + 1)
                                      if sum(x in "01" for x in r["w"][i:i + size]) > decontam.MOST_PLACEHOLDERS * size]


def test_contamination_with_odd_rows(spark):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id bigint, text string").withColumn("hash", F.lit(1))
    frame = documents(spark, [(1, BENCHMARK[0][1]), (1, "clean"), (None, BENCHMARK[0][1]), (2, "clean " * 5000)]).withColumn("place", F.lit(0))
    result = decontam.contamination(frame, benchmark)
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in result.collect()) == [(0, True), (1, True), (1, True), (2, False)]
    assert decontam.contamination(frame.limit(0), benchmark).count() == 0
    assert decontam.contamination(frame, benchmark.limit(0)).filter("contaminated").count() == 0
    assert "Python" not in result._jdf.queryExecution().executedPlan().toString()


ODD_TEXTS = ["", None, "a\x1cb c", "don't we'll X's 'sx", "<|endoftext|>a b<|startoftext|>", "é ́x a\x85d", "日本 語Σ ΑΣ", "a​b",
             "İstanbul ǅ ﬁ ½", "x " * 3000, "y" * 5000, "a  b", " lead", "tab\tline\n\n\x00end", "1234 == ---- ////", "😀é"]


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i * 3 - 5, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id"), (4, ODD_TEXTS[3])]
    manifest, folder, dtype = tokenfiles.build_token_files(documents(spark, rows), path, end_id=1)
    assert dtype == "<u2"
    result = sorted(tokenfiles.read_files(manifest, folder, dtype).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in result]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    texts = dict(rows)
    start = 0
    for row in result:
        ids = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfiles.token_file_digest(documents(spark, rows).limit(0), path).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    texts = ODD_TEXTS + ["".join(rnd.choice("abcdefgh the ing tion 0123 \n\t éü日▁") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    frame = documents(spark, list(enumerate(texts))).withColumn("ids", F.lit(1))
    result = {r["doc_id"]: r for r in pieces.encode_documents(frame, path).collect()}
    for i, text in enumerate(texts):
        assert result[i]["ids"] == library.encode(text or "") and result[i]["n_tokens"] == len(result[i]["ids"])
        assert result[i]["round_trip"]
    encoded = pieces.encode_documents(frame, path)
    back = encoded.select("doc_id", pieces.decode_column(F.col("ids"), path).alias("back")).collect()
    assert all(r["back"] == (texts[r["doc_id"]] or "").replace("▁", " ") for r in back)
    assert pieces.ids_digest(encoded.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = common.Scratch(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        if name == "near_duplicates":
            again = neardup.near_duplicates(after)
            assert again.filter("not kept").count() == 0
        if name == "decontamination":
            assert decontam.contamination(after, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter("round_trip").count() == docs.count()


def test_one_copy_stays_of_repeated_rows(spark):
    frame = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q"), (3, "other words here"), (4, None)])
    kept = corpus_pipeline.keep_one_copy(spark, frame, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3, 4]


def test_stages_decide_on_rows_without_an_id(spark):
    """Copies and leaks go although their rows have no id; other such rows, blank ones included, stay as they were."""
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() if r["text"]), key=len)
    rows = [(None, f"before {item} after"), (None, "some plain words that nobody has ever put into a test"), (5, "one more plain text of a few words"), (None, None), (None, " "),
            (None, "")]
    left = corpus_pipeline.drop_leaks(spark, documents(spark, rows), SF)
    assert left.schema["doc_id"] == documents(spark, rows).schema["doc_id"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in rows[1:])
    copies = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (7, "g h i j k l"), (None, None), (None, None), (None, " ")]
    kept = corpus_pipeline.keep_one_copy(spark, documents(spark, copies), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, ""), (0, " "), (0, "a b c d e f"), (7, "g h i j k l")]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, documents(spark, rows).limit(0), SF).count() == 0
