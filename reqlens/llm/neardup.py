"""Near-duplicate components: SetSketch registers, bands, joint likelihood, exact verification.

Equal word sequences are one class; only one member of a class is sketched further. A register holds the
exponent of an exponentially spaced, truncated minimum, so sketches of parts merge by their maximum and
equal registers tell of overlap. Classes that agree in a band of registers share a bucket. A bucket's
pairs are never listed: first all members are compared with the bucket's most popular member, which joins
most of a large group. What is still apart in a bucket is compared in blocks by the joint likelihood of
the sketches; rows that have a likely partner meet again with their full shingle sets, and only links
that connect something leave the task. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from reqlens.llm.common import Scratch, identified_texts

WORDS = 5  # of a shingle
SIMILARITY = 75  # per cent: 100 * intersection >= SIMILARITY * union
BANDS, BAND_REGISTERS = 40, 5  # a pair at 0.75 shares no band with probability 2e-5
REGISTERS = BANDS * BAND_REGISTERS
BASE, RATE = 1.08, 20.0  # spacing of the register values; rate of the exponential hashes
DOUBT = 8.0  # a pair is verified unless its log likelihood at the wanted similarity is that much below its best
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000  # rows and shingles of a bucket compared with each other in one group
BROADCAST_IDS = 2_000_000  # up to so many ids (16 MB) are broadcast to pick texts; beyond, the texts are shuffled

_RANDOM = np.random.default_rng(20_11)
_FACTORS = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GRID = np.linspace(0.0, 1.0, 41)


def words_of(text: str) -> list[bytes]:
    """Words between blanks (space, tab to carriage return), A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of five words; fewer words are one shingle; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k:k + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    if width < WORDS:
        mixed = mixed * _MIX + np.uint64(width)
    return np.unique(mixed)


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Register values of a set: 0 without elements; the sketch of a union is the maximum of its parts'."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint8)
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        values = low[at:at + 512, None] * _FACTORS
        values += high[at:at + 512, None]
        np.minimum(least, values.min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 255).astype(np.uint8)


def plausible(equal: np.ndarray, larger: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether the joint likelihood of two sketches allows the wanted similarity.

    ``equal`` and ``larger`` count registers that agree and that are larger in the first set; ``first``
    and ``second`` are the exact set sizes. The best similarity on a grid must not be more likely than
    the wanted one by ``DOUBT``, unless it is larger.
    """
    smaller = REGISTERS - equal - larger
    share = (first / (first + second))[:, None]
    most = np.minimum(first, second) / np.maximum(first, second)

    def fits(similarity: np.ndarray) -> np.ndarray:
        step = lambda x: -np.log1p(-np.maximum(x, 1e-9) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = step(share - (1 - share) * similarity), step(1 - share - share * similarity)
        return larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-9))

    grid = np.minimum(_GRID[None, :], most[:, None])
    table = fits(grid)
    best = table.argmax(axis=1)
    wanted = np.minimum(SIMILARITY / 100, most)[:, None]
    return (np.take_along_axis(grid, best[:, None], axis=1) >= wanted)[:, 0] | (table.max(axis=1) - fits(wanted)[:, 0] <= DOUBT)


def size_allows(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(first, second) >= SIMILARITY * np.maximum(first, second)


def signatures(documents: DataFrame) -> DataFrame:
    """``doc_id, class_key, n_shingles, sketch``; the key is null without words or without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for named, text in zip(batch.column(0).is_valid().to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                shingles = shingle_set(words)
                sizes.append(len(shingles))
                keys.append(hashlib.md5(b" ".join(words)).digest() if words and named else None)
                sketches.append(set_sketch(shingles).tobytes() if words and named else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(sketches, pa.binary())], ["doc_id", "class_key", "n_shingles", "sketch"])

    return identified_texts(documents).mapInArrow(run, "doc_id bigint, class_key binary, n_shingles bigint, sketch binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """``bucket, band, node``: one row per class and band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.xxhash64(
        band, F.substring("sketch", band * BAND_REGISTERS + 1, F.lit(BAND_REGISTERS))))
    return classes.select("node", "n_shingles", F.posexplode(keys).alias("band", "bucket"))


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs ``a, b`` those that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            x, y = _bytes_matrix(batch.column(3)), _bytes_matrix(batch.column(5))
            good = size_allows(first, second)
            good[good] = plausible((x[good] == y[good]).sum(axis=1), (x[good] > y[good]).sum(axis=1), first[good], second[good])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    side = lambda name: classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
            .mapInArrow(run, "a bigint, b bigint"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that split no group; the first ``keys`` columns name the group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        # The last group may go on in the next batch; it has two blocks at most.
        names = [table.column(k).combine_chunks().to_numpy() for k in range(keys)]
        cut = int(np.argmax(np.logical_and.reduce([name == name[-1] for name in names])))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _likely_within(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that are likely links of different roots, in the first band that both share.

    ``table``: ``bucket, low, high, own, band, node, root, n_shingles, sketch``. Rows at distance 1, 2, ...
    of each other are compared for all groups at once.
    """
    bucket, low, high, side, band, _, root, size = (table.column(k).combine_chunks().to_numpy() for k in range(8))
    sketch = _bytes_matrix(table.column(8).combine_chunks())
    start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    ends = np.repeat(np.concatenate([start[1:], [len(bucket)]]), np.diff(np.concatenate([start, [len(bucket)]])))
    active, lag = np.arange(len(bucket)), 1
    while len(active := active[active + lag < ends[active]]):
        i, j = active, active + lag
        lag += 1
        keep = (root[i] != root[j]) & ((side[i] != side[j]) | (low[i] == high[i])) & size_allows(size[i], size[j])
        i, j = i[keep], j[keep]
        same = sketch[i] == sketch[j]
        alike = same.sum(axis=1)
        some = alike >= REGISTERS // 2
        i, j, same, alike = i[some], j[some], same[some], alike[some]
        if len(i):
            first = same.reshape(-1, BANDS, BAND_REGISTERS).all(axis=2).argmax(axis=1) == band[i]
            i, j, alike = i[first], j[first], alike[first]
            good = plausible(alike, (sketch[i] > sketch[j]).sum(axis=1), size[i], size[j])
            yield i[good], j[good]


def rows_apart(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows ``bucket, low, high, own, band, node, root`` that have a likely link to a row of another root.

    ``rows``: ``bucket, band, blocks, node, root``. A bucket is dealt into blocks, and every two blocks
    meet in one group.
    """
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    dealt = (rows.join(classes, "node").withColumn("own", own)
             .select("bucket", "band", "node", "root", "n_shingles", "sketch", "own",
                     F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}))
    ordered = (dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "own", "node")
               .select("bucket", "low", "high", "own", "band", "node", "root", "n_shingles", "sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            found = [np.concatenate(pair) for pair in _likely_within(table)]
            chosen = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            yield from table.select(list(range(7))).take(pa.array(chosen)).combine_chunks().to_batches()

    return ordered.mapInArrow(run, "bucket bigint, low int, high int, own int, band int, node bigint, root bigint")


def links_within(entries: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between the rows of ``rows_apart``, confirmed on the full sets within the task.

    A group yields at most one link fewer than it has rows: pairs that are connected by then are skipped.
    """
    named = sets.select(F.col("node").alias("set_node"), "shingles")
    ordered = (entries.join(classes, "node").join(named, F.col("node") == F.col("set_node"))
               .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "own", "node")
               .select("bucket", "low", "high", "own", "band", "node", "root", "n_shingles", "sketch", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            nodes = table.column(5).to_pylist()
            held = [np.frombuffer(value.as_buffer(), np.uint64) for value in table.column(9)]
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := above.get(x, x)) != x:
                    above[x] = above.get(up, up)
                    x = up
                return x

            roots, a, b = table.column(6).to_pylist(), [], []
            for left, right in _likely_within(table):
                for i, j in zip(left.tolist(), right.tolist()):
                    x, y = top(roots[i]), top(roots[j])
                    if x != y and linked(held[i], held[j]):
                        above[x] = y
                        a.append(nodes[i])
                        b.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def linked(first: np.ndarray, second: np.ndarray) -> bool:
    """Whether two sorted shingle sets reach the similarity."""
    both = np.concatenate([first, second])
    both.sort(kind="stable")  # two sorted runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return len(first) > 0 and 100 * common >= SIMILARITY * (len(both) - common)


def full_sets(nodes: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, shingles`` of the given nodes (one column); only their texts are read again."""
    ids = scratch.keep(nodes.toDF("wanted_id").distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = identified_texts(documents)
    texts = texts.join(wanted, texts["doc_id"] == F.col("wanted_id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingle_set(words_of(text.as_py())).tobytes() for text in batch.column(1)], pa.binary())], ["node", "shingles"])

    return scratch.keep(texts.mapInArrow(run, "node bigint, shingles binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs ``a, b`` those whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                             for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(run, "a bigint, b bigint"))


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of all nodes in ``links`` (``a, b``): equal roots for connected nodes.

    Each round every node joins its neighbour of the smallest hash, itself included; the joined nodes are
    one from then on. The hashes make each round remove a constant share of the nodes. Joins and
    combining aggregates only, written between rounds.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = scratch.keep(both.distinct(), "edges")
    labels = scratch.keep(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        code = lambda name: F.struct(F.xxhash64(name), F.col(name).alias("id"))
        parents = scratch.keep(edges.groupBy("a").agg(F.min(code("b")).alias("near"))
                               .select("a", F.least("near", code("a"))["id"].alias("parent")), "parents")
        new_edges = (edges.join(parents, "a").select(F.col("parent").alias("to_a"), F.col("b").alias("a"))
                     .join(parents, "a").select(F.col("to_a").alias("a"), F.col("parent").alias("b")).filter("a <> b").distinct())
        new_labels = (labels.join(parents.withColumnRenamed("a", "root"), "root", "left")
                      .select("node", F.coalesce("parent", "root").alias("root")))
        replaced = (edges, labels, parents)
        edges, labels = scratch.keep(new_edges, "edges"), scratch.keep(new_labels, "labels")
        scratch.drop(*replaced)
    return labels


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Two documents are linked when 100 * |intersection| >= 75 * |union| of their distinct 5-word
    shingles; a shorter text is one shingle, a text without words (null, empty, blanks) has none, is
    linked with nothing and is its own component. ``component_id`` is the smallest id reachable, ``kept``
    marks it. Rows with one id count as one document. Rows without an id take no part: no component,
    kept. An empty table gives an empty result. Only ids and texts are read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    signed = scratch.keep(signatures(documents), "signatures")
    classes = scratch.keep(signed.filter("class_key is not null").groupBy("class_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    sketched = classes.select("node", "n_shingles", "sketch")

    rows = bucket_rows(classes)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")).filter("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    shared = scratch.keep(rows.join(sizes, "bucket").select("bucket", "band", "members", blocks.alias("blocks"), "node"), "buckets")

    # Every member against the member that lies in the largest buckets: the middle of a group of copies.
    popular = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    centre = (shared.join(popular, "node").groupBy("bucket")
              .agg(F.max(F.struct("weight", (-F.col("node")).alias("opposite"))).alias("best"))
              .select("bucket", (-F.col("best.opposite")).alias("centre")))
    spokes = (shared.join(centre, "bucket").filter("node <> centre")
              .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    likely = scratch.keep(likely_pairs(spokes, sketched), "likely")
    sets = full_sets(likely.select(F.explode(F.array("a", "b"))), documents, scratch)
    links = scratch.keep(confirmed(likely, sets), "links")
    scratch.drop(sets)
    labels = connected(links, scratch)

    # What is still apart in a bucket.
    rooted = shared.join(labels, "node", "left").select("bucket", "band", "blocks", "node", F.coalesce("root", "node").alias("root"))
    mixed = (rooted.groupBy("bucket").agg(F.min("root").alias("least_root"), F.max("root").alias("most_root"))
             .filter("least_root < most_root").select("bucket"))
    entries = scratch.keep(rows_apart(rooted.join(mixed, "bucket", "left_semi"), sketched), "apart")
    sets = full_sets(entries.select("node"), documents, scratch)
    more = scratch.keep(links_within(entries, sketched, sets), "more")
    scratch.drop(sets)
    rooted_links = (more.join(labels.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
                    .join(labels.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
                    .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    merged = connected(rooted_links, scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
    nodes = (classes.select("class_key", "node").join(labels, "node", "left")
             .select("class_key", "node", F.coalesce("root", "node").alias("root"))
             .join(merged, "root", "left").select("class_key", "node", F.coalesce("top", "root").alias("top")))
    smallest = nodes.groupBy("top").agg(F.min("node").alias("component"))
    found = nodes.join(smallest, "top").select(F.col("class_key").alias("found_key"), "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (signed.join(found, signed["class_key"] == found["found_key"], "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
