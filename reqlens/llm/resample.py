"""Importance resampling towards a target distribution, on hashed word n-grams.

The documents' and the target texts' n-grams are counted in hashed buckets over all data. A bucket's gain is the
logarithm of its smoothed share in the target over that in the documents; a document weighs the sum of its gains.
Adding Gumbel noise (from a hash of the id) and taking the highest scores draws documents without replacement in
proportion to their weights.

A worker interns the n-grams of a batch in an open-addressed NumPy table: xxhash64 of an n-gram's bytes is its key,
linear probing finds its slot, and equal keys are verified byte by byte. A slot holds the n-gram's bucket and count,
so the checksum behind a bucket is taken once per different n-gram; every occurrence keeps its slot's id and gathers
from there. Interning costs far more than all the rest, so it happens once: the buckets gathered for each document are
written, two bytes for an n-gram, and both the counts and the weights are taken from that table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from reqlens.llm.common import Scratch

BUCKETS = 10_000
ORDERS = (1, 2, 3)  # words of an n-gram
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 5
SEED = 42
PIECE = 1 << 18  # bytes of text that are interned at once

# Bytes of words (digits, letters and all bytes beyond ASCII) in small letters; all others are a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


# The multipliers of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_CRC_POLYNOMIAL = 0xEDB88320  # Fixed value: CRC-32, reflected
_COMBINED = 64  # checksums of n-grams whose last word is longer are taken from their bytes


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _byte_table() -> np.ndarray:
    """What the lowest byte of a checksum becomes behind one more byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(_CRC_POLYNOMIAL) ^ (step >> 1), step >> 1).astype(np.uint32)
    return step


def _zeros_tables(step: np.ndarray) -> np.ndarray:
    """Flat ``[n][k][v]``: what value ``v`` in byte ``k`` of a checksum becomes behind ``n`` more bytes."""
    tables = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])]
    for _ in range(_COMBINED):
        tables.append(step[tables[-1] & 255] ^ (tables[-1] >> np.uint32(8)))
    return np.array(tables, dtype=np.uint32).ravel()


_STEP = _byte_table()
_ZEROS = _zeros_tables(_STEP)
_SPACE = np.uint32(zlib.crc32(b" "))


def joined_checksum(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of left text and right text from theirs; ``length`` is the right text's, up to ``_COMBINED`` bytes."""
    base, moved = length * 1024, right
    for k in range(4):
        moved = moved ^ _ZEROS[base + (256 * k) + ((left >> np.uint32(8 * k)) & np.uint32(255))]
    return moved


class Ranges:
    """Ranges of one buffer of text: their hashes, their equality, and a table that interns them."""

    def __init__(self, text: bytes):
        self.text = text
        padded = np.frombuffer(text + bytes(16), dtype=np.uint8)
        # The eight bytes from each place on, as one number.
        self.eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(text) + 8].copy().view("<u8").ravel()

    def hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """XXH64 with seed 0; ranges of 32 bytes and more by the library."""
        out = _P5 + lengths.astype(np.uint64)
        for done in (0, 8, 16):
            at = np.flatnonzero(lengths >= done + 8)
            lane = _turned(self.eight[starts[at] + done] * _P2, 31) * _P1
            out[at] = _turned(out[at] ^ lane, 27) * _P1 + _P4
        at = np.flatnonzero(lengths & 4)
        half = self.eight[starts[at] + (lengths[at] & ~7)] & np.uint64(0xFFFFFFFF)
        out[at] = _turned(out[at] ^ (half * _P1), 23) * _P2 + _P3
        rest = lengths & 3
        last = self.eight[starts + (lengths & ~3)]
        for k in range(3):
            at = np.flatnonzero(rest > k)
            out[at] = _turned(out[at] ^ (((last[at] >> np.uint64(8 * k)) & np.uint64(255)) * _P5), 11) * _P1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        out ^= out >> np.uint64(32)
        for at in np.flatnonzero(lengths >= 32).tolist():
            out[at] = xxhash.xxh64_intdigest(self.text[starts[at]:starts[at] + lengths[at]])
        return out

    def checksums(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC-32; ranges of over ``_COMBINED`` bytes by the library."""
        state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
        short = np.where(lengths <= _COMBINED, lengths, 0)
        for k in range(int(short.max(initial=0))):
            at = np.flatnonzero(short > k)
            byte = self.eight[starts[at] + k].astype(np.uint32)
            state[at] = _STEP[(state[at] ^ byte) & np.uint32(255)] ^ (state[at] >> np.uint32(8))
        state = ~state
        for at in np.flatnonzero(lengths > _COMBINED).tolist():
            state[at] = zlib.crc32(self.text[starts[at]:starts[at] + lengths[at]])
        return state

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ranges of equal ``length`` that begin at ``a`` and ``b`` hold the same bytes."""
        same = np.ones(len(a), dtype=bool)
        left, done = np.arange(len(a)), 0
        while len(left):
            # Bytes beyond the range are shifted out.
            beyond = (np.uint64(8) * np.maximum(8 - (length[left] - done), 0).astype(np.uint64))
            same[left] = ((self.eight[a[left] + done] ^ self.eight[b[left] + done]) << beyond) == 0
            done += 8
            left = left[same[left] & (length[left] > done)]
        return same

    def intern(self, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each range's slot, numbered from 0, and for each slot a range that it holds (open addressing)."""
        keys = self.hashes(starts, lengths)
        size = 1 << max(4, (2 * len(starts)).bit_length())
        owner = np.full(size, -1, dtype=np.int64)
        found = np.empty(len(starts), dtype=np.int64)
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        waiting = np.arange(len(starts))
        while len(waiting):
            slots = at[waiting]
            free = owner[slots] < 0
            owner[slots[free]] = waiting[free]
            holder = owner[slots]
            same = holder == waiting
            other = np.flatnonzero(~same)
            alike = other[(keys[holder[other]] == keys[waiting[other]]) & (lengths[holder[other]] == lengths[waiting[other]])]
            same[alike] = self.equal(starts[holder[alike]], starts[waiting[alike]], lengths[waiting[alike]])
            found[waiting[same]] = slots[same]
            waiting = waiting[~same]
            at[waiting] = (at[waiting] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        number = np.empty(size, dtype=np.int64)
        number[used] = np.arange(len(used))
        return number[found], owner[used]


def pieces_of(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """Buffers of whole words: text in small letters with one space between words, the document of each word, where
    the words begin, and how many words at the beginning only lend their bytes to n-grams.

    Short texts share a buffer. A text beyond ``most`` bytes is cut between words, and its next buffer begins with the last words of the one before.
    """
    group, size = [], 0
    for number, text in enumerate(texts):
        if size + len(text) > most and group:
            yield _buffer(group)
            group, size = [], 0
        group.append((number, text))
        size += len(text)
        if size > most:  # one long text
            yield from _long(number, text, most)
            group, size = [], 0
    if group:
        yield _buffer(group)


def _long(number: int, text: bytes, most: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    carried, start = b"", 0
    while start < len(text):
        stop = min(start + most, len(text))
        while stop < len(text) and _WORDS[text[stop]] != 32:
            stop += 1
        made, document, starts, _ = _buffer([(number, carried + b" " + text[start:stop])])
        kept = min(len(starts), len(carried.split(b" ")) if carried else 0)
        yield made, document, starts, kept
        lent = max(ORDERS) - 1
        carried = made[starts[-lent] if len(starts) >= lent else 0:].rstrip(b" ") if len(starts) else b""
        start = stop


def _buffer(group: list[tuple[int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    joined = b" ".join(text for _, text in group).translate(_WORDS) + b" "
    numbers = np.array([number for number, _ in group], dtype=np.int64)
    bounds = np.cumsum([len(text) + 1 for _, text in group])
    signs = np.frombuffer(joined, dtype=np.uint8)
    word = signs != 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    document = numbers[np.searchsorted(bounds, np.flatnonzero(begins), side="right")]
    kept = word.copy()
    kept[1:] |= word[:-1]
    made = signs[kept]
    space = made == 32
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(made) else np.zeros(0, dtype=np.int64)
    return made.tobytes(), document, starts.astype(np.int64), 0


def occurrences(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each buffer and number of words: the document and the slot of every n-gram, the slots' buckets and counts."""
    for made, document, starts, lent in pieces_of(texts, most):
        if not len(starts):
            continue
        ranges = Ranges(made)
        lengths = np.append(starts[1:] - 1, len(made) - 1) - starts
        words = before = np.zeros(0, dtype=np.uint32)  # checksums of the words, of the n-grams one word shorter by their last word
        for order in ORDERS:
            last = np.arange(order - 1, len(starts))
            last = last[document[last - order + 1] == document[last]]
            first = last - order + 1
            begin, length = starts[first], starts[last] + lengths[last] - starts[first]
            slots, held = ranges.intern(begin, length)
            if order == 1:
                checksums = ranges.checksums(begin[held], length[held])
            else:
                end = last[held]
                one = np.ones(len(end), dtype=np.int64)
                spaced = joined_checksum(before[end - 1], np.full(len(end), _SPACE), one)
                checksums = joined_checksum(spaced, words[end], np.minimum(lengths[end], _COMBINED))
                long = np.flatnonzero(lengths[end] > _COMBINED)
                checksums[long] = ranges.checksums(begin[held[long]], length[held[long]])
            before = np.zeros(len(starts), dtype=np.uint32)
            before[last] = checksums[slots]
            words = before if order == 1 else words
            own = last >= lent  # an n-gram belongs to the buffer that holds its last word
            slots = slots[own]
            yield order, document[last[own]], slots, (checksums % BUCKETS).astype(np.int64), np.bincount(slots, minlength=len(held))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if text is None else text for text in batch.column("text").cast(pa.binary()).to_pylist()]


def interned(texts: DataFrame, key: str) -> DataFrame:
    """``key, n_words, n_features, buckets`` of every text; ``buckets`` holds an unsigned 16-bit number for each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            words, features = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            parts: list[list[bytes]] = [[] for _ in range(size)]
            for order, owner, slots, buckets, _ in occurrences(_texts(batch)):
                here = np.bincount(owner, minlength=size)
                features += here
                words += here if order == 1 else 0
                gathered = memoryview(buckets.astype("<u2")[slots]).cast("B")  # owners ascend
                stops = 2 * np.cumsum(here)
                for number in np.flatnonzero(here).tolist():
                    parts[number].append(bytes(gathered[stops[number] - 2 * here[number]:stops[number]]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(words), pa.array(features), pa.array(map(b"".join, parts), pa.binary())],
                                             names=[key, "n_words", "n_features", "buckets"])

    rows = texts.select(key, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(made: DataFrame) -> DataFrame:
    """``bucket, count`` of all n-grams of an interned table; buckets without one are left out.

    Each task sends one row for each bucket it met, at most ``BUCKETS``, whatever its texts hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for held in batch.column("buckets"):
                total += np.bincount(np.frombuffer(held.as_buffer(), "<u2"), minlength=BUCKETS)
        met = np.flatnonzero(total)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "count"])

    return made.select("buckets").mapInArrow(run, "bucket bigint, count bigint").groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from two interned tables: ``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))``."""
    spark, zero = documents.sparkSession, F.lit(0).cast("bigint")
    own = bucket_counts(documents).select("bucket", F.col("count").alias("s"), zero.alias("t"))
    wanted = bucket_counts(target).select("bucket", zero.alias("s"), F.col("count").alias("t"))
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"), zero.alias("s"), zero.alias("t"))
    both = own.unionAll(wanted).unionAll(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    rows = both.toPandas().sort_values("bucket")  # ``BUCKETS`` rows
    s, t = rows["s"].to_numpy(np.float64), rows["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weight_column(buckets: Column, gains: np.ndarray, documents: DataFrame) -> Column:
    """The sum of the gains of a document's n-grams."""
    sent = documents.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([int(sent.value[np.frombuffer(held, "<u2")].sum()) for held in batch], dtype=np.int64)

    return F.pandas_udf(run, "bigint")(buckets)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """``floor(-1000 ln(-ln((h+0.5)/2^32)))`` with the first 32 bits of sha256 of seed and id; null for null ids."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), "UTF-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(scored: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` to the ``percent`` highest scores of the rows with enough words, ties to smaller ids.

    Only rows that can be drawn are sorted, by ranges of the score; a range's first rank is the number of rows in
    the ranges before it. No task and no group ever holds all of them.
    """
    able = scored.filter((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    drawn = able.count() * percent // 100
    none = scored.withColumn("rank", F.lit(None).cast("bigint"))
    if not drawn:
        return none
    # A score that is safely below the last one drawn: the approximation is off by one in ten thousand rows.
    floor = able.agg(F.percentile_approx("score", F.lit(max(0.0, 1 - percent / 100 - 0.01)), F.lit(10_000)).alias("floor")).first()["floor"]
    if able.filter(F.col("score") >= floor).count() < drawn:
        floor = able.agg(F.min("score").alias("floor")).first()["floor"]
    high = (F.col("n_words") >= least_words) & F.col("score").isNotNull() & (F.col("score") >= floor)
    order = [F.desc("score"), F.asc("doc_id")]
    by_score = scored.filter(high).repartitionByRange(*order).sortWithinPartitions(*order)
    # A number of Spark's own for each row: the partition above, the place in it in the lower 33 bits.
    numbered = scratch.keep(by_score.withColumn("number", F.monotonically_increasing_id()), "by-score")
    part = F.shiftright("number", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))  # one row per partition
    place = F.col("before") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = numbered.withColumn("part", part).join(F.broadcast(ranges), "part")
    drawn_rows = placed.select(*scored.columns, F.when(place <= drawn, place).cast("bigint").alias("rank"))
    return none.filter(~F.coalesce(high, F.lit(False))).unionByName(drawn_rows)


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn.

    Words are runs of ASCII letters (in small letters), digits and all signs beyond ASCII, over whole texts. Null and
    empty texts have no features and weight 0. Rows without an id have no score, do not count among those that may be drawn
    and are never drawn. Repeated rows count each; those equal in score and id are ranked one after the other. Empty
    tables give an empty result; an empty target gives gains by the documents' counts alone. Only
    ``doc_id`` and ``text`` are read. Very long texts are interned in pieces of ``PIECE`` bytes, cut between words.
    """
    scratch = Scratch(documents.sparkSession, "resample")
    made = scratch.keep(interned(documents, "doc_id"), "interned")
    gains = bucket_gains(made, interned(target.withColumn("doc_id", F.lit(0)), "doc_id"))
    weighed = made.select("doc_id", "n_words", "n_features", weight_column(F.col("buckets"), gains, documents).alias("weight"))
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    scratch.drop(made)
    return ranked(scored, scratch, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
