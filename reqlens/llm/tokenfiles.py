"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped when read."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reqlens.llm.common import Scratch, identified_texts

_MEMO_CHUNKS = 1_000_000  # chunks that a worker remembers; beyond, it starts anew
_LONG_CHUNK = 256  # bytes; longer chunks get a cryptographic hash
_BATCH_CHARS = 2_000_000
_STATE: dict = {}

_RANDOM = np.random.default_rng(90_210)
_FACTOR = int(_RANDOM.integers(0, 1 << 62)) * 2 + 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_RAW = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _RAW.copy()
_FOLDED[65:91] = _RAW[97:123]
_BLANK = np.isin(np.arange(256), list(b" \t\r\n"))
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGN = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


class ChunkEncoder:
    """Encodes texts chunk by chunk; every different chunk is encoded once by the library.

    The tokenizer treats white space as a boundary and drops it, and never joins an ASCII letter with a
    sign behind it, so texts may be cut there. It lowers case, so chunks that differ in A-Z only are the
    same (batches that hold the opening of a special token are neither cut there nor folded). Chunks are told apart by
    64-bit hashes that are taken from running sums, all at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode_new(self, keys: list[int], words: list[str]) -> None:
        """Many chunks at a time as one text; the places of the tokens tell the chunks apart."""
        for start in range(0, len(words), 200):
            own = words[start:start + 200]
            coded = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            begins = np.cumsum([0, *(len(word) + 1 for word in own)])
            at = np.searchsorted(begins, np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids)), side="right")
            cuts = np.searchsorted(at, np.arange(1, len(own) + 2))
            first, most = len(self.slots), len(self.slots) + len(own)
            while self.used + len(coded.ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while most > len(self.begins):
                self.begins, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.counts))
            self.ids[self.used:self.used + len(coded.ids)] = coded.ids
            self.begins[first:most], self.counts[first:most] = self.used + cuts[:-1], np.diff(cuts)
            self.used += len(coded.ids)
            self.slots.update(zip(keys[start:start + 200], range(first, most)))

    def _keys(self, blob: bytes, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(codes) + 1:
            for name, factor in (("powers", _FACTOR), ("inverses", _INVERSE)):
                steps = np.full(len(codes) + 1, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        table = _RAW if b"<|" in blob else _FOLDED
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[codes] * self.powers[:len(codes)], dtype=np.uint64)])
        keys = (sums[ends] - sums[starts]) * self.inverses[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(_FACTOR)
        keys ^= keys >> np.uint64(31)
        for k in np.flatnonzero(ends - starts > _LONG_CHUNK).tolist():
            keys[k] = int.from_bytes(hashlib.blake2b(blob[starts[k]:ends[k]], digest_size=8).digest(), "little")
        return keys

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        raw = [text.encode("utf-8") for text in texts]
        blob = b"\n".join(raw) + b"\n"
        codes = np.frombuffer(blob, np.uint8)
        solid = ~_BLANK[codes]
        cut = np.zeros(len(codes), bool)
        if b"<|" not in blob:
            cut[1:] = _LETTER[codes[:-1]] & _SIGN[codes[1:]]
        first = solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | cut[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.slots) > _MEMO_CHUNKS:
            self._forget()
        keys, where, back = np.unique(self._keys(blob, codes, starts, ends), return_index=True, return_inverse=True)
        keys = keys.tolist()
        new = [k for k, key in enumerate(keys) if key not in self.slots]
        self._encode_new([keys[k] for k in new], [blob[starts[where[k]]:ends[where[k]]].decode("utf-8") for k in new])
        slots = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))[back]
        counts = self.counts[slots]
        total = np.cumsum(counts)
        flat = self.ids[np.repeat(self.begins[slots] - total + counts, counts) + np.arange(total[-1])]
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        upto = np.concatenate([[0], total])[np.searchsorted(starts, text_ends)]
        return flat, np.diff(upto, prepend=0)


def chunk_encoder(path: str) -> ChunkEncoder:
    """One per worker process."""
    if path not in _STATE:
        _STATE[path] = ChunkEncoder(path)
    return _STATE[path]


def runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that end once their sizes reach ``most``, one row at least."""
    start = total = at = 0
    for at, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, at
            start, total = at, 0
    if at > start:
        yield start, at


def slices(texts: Iterable[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that end once they have ``most`` characters, one row at least."""
    return runs(map(len, texts), most)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _publish(files: fs.FileSystem, path: str, attempt: int, parts: Iterable[bytes]) -> None:
    """Write under the attempt's own name, then rename: a lost or repeated attempt leaves no half file."""
    with files.open_output_stream(own := f"{path}.attempt-{attempt}") as out:
        for part in parts:
            out.write(part)
    files.move(own, path)


def _mapped(files: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped on a local or mounted folder, read where the store has no mapping."""
    if not files.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with files.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def write_files(documents: DataFrame, tokenizer_path: str, end_id: int, folder: str, dtype: str, partitions: int) -> DataFrame:
    """Write ids in ascending ``doc_id`` order; returns ``part, docs, tokens, base``, one row per partition.

    Texts are dealt by ranges of ids and sorted; the task that writes a range encodes it, so ids are
    never shuffled. Per partition three flat little-endian files: ``.ids`` (``dtype``), ``.docs`` (pairs
    of 64-bit null flag and id) and ``.offsets`` (unsigned 64-bit starts in the whole corpus, one more
    than documents). A partition's base is the sum of the partitions before it.
    """
    spark = documents.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        context, encoder = TaskContext.get(), chunk_encoder(tokenizer_path)
        part, attempt = context.partitionId(), context.taskAttemptId()
        files.create_dir(root, recursive=True)
        lengths, docs = [], []

        def flat() -> Iterator[bytes]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                docs.append(np.stack([ids.is_null().to_numpy(zero_copy_only=False).astype("<i8"),
                                      ids.fill_null(0).to_numpy().astype("<i8")], axis=1).tobytes())
                for start, stop in slices(texts, _BATCH_CHARS):
                    flat_ids, counts = encoder.encode(texts[start:stop])
                    lengths.extend((counts + 1).tolist())
                    yield np.insert(flat_ids, np.cumsum(counts), end_id).astype(dtype).tobytes()

        _publish(files, f"{root}/{part:06d}.ids", attempt, flat())
        _publish(files, f"{root}/{part:06d}.docs", attempt, docs)
        _publish(files, f"{root}/{part:06d}.lengths", attempt, [np.array(lengths, "<u8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(lengths)]), pa.array([int(sum(lengths))])],
                                         ["part", "docs", "tokens"])

    texts = identified_texts(documents)
    ordered = (texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text"))
    totals = Scratch(spark, "parts").keep(ordered.mapInArrow(write, "part bigint, docs bigint, tokens bigint"), "totals")
    # One small row per file; a running sum over them gives the bases.
    rows, base, manifest = sorted(totals.collect(), key=lambda r: r["part"]), 0, []
    for row in rows:
        manifest.append((row["part"], row["docs"], row["tokens"], base))
        base += row["tokens"]
    parts = spark.createDataFrame(manifest, "part bigint, docs bigint, tokens bigint, base bigint")

    def offsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(folder)
        for frame in frames:
            for row in frame.itertuples():
                lengths = _mapped(files, f"{root}/{row.part:06d}.lengths", "<u8")
                starts = row.base + np.concatenate([[0], np.cumsum(lengths, dtype="<u8")])
                _publish(files, f"{root}/{row.part:06d}.offsets", TaskContext.get().taskAttemptId(), [starts.astype("<u8").tobytes()])
                yield pd.DataFrame({"part": [row.part], "docs": [row.docs], "tokens": [row.tokens], "base": [row.base]})

    spread = parts.repartition(max(1, len(manifest)), "part") if manifest else parts
    return Scratch(spark, "parts").keep(spread.mapInPandas(offsets, parts.schema), "manifest")


def read_files(manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(folder)
        for frame in frames:
            for row in frame.itertuples():
                ids = _mapped(files, f"{root}/{row.part:06d}.ids", dtype)
                docs = _mapped(files, f"{root}/{row.part:06d}.docs", "<i8").reshape(-1, 2)
                offsets = np.asarray(_mapped(files, f"{root}/{row.part:06d}.offsets", "<u8")).astype(np.int64)
                first = offsets[0] if len(offsets) else 0
                for at in range(0, len(docs), 10_000):
                    own = offsets[at:at + 10_001]
                    here = docs[at:at + 10_000]
                    yield pd.DataFrame({
                        "doc_id": pd.array(here[:, 1], dtype="Int64").copy() if not here[:, 0].any()
                        else pd.array([None if null else int(i) for null, i in here], dtype="Int64"),
                        "start": own[:-1], "n_tokens": np.diff(own),
                        "ids_crc32": [zlib.crc32(np.asarray(ids[a - first:b - first]).astype("<u4").tobytes())
                                      for a, b in zip(own[:-1], own[1:])]})

    return manifest.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def build_token_files(documents: DataFrame, tokenizer_path: str, end_id: int = 1,
                      folder: str | None = None, dtype: str | None = None) -> tuple[DataFrame, str, str]:
    """Encode, write and index a corpus; returns the manifest, the folder and the integer type.

    Null texts are empty and hold the end id alone. Null ids come first, rows with equal ids in the
    order of a hash of the text, then of the text. An empty table gives an empty manifest or empty files. Unsigned 16-bit
    integers where the vocabulary fits, else 32-bit. Only ids and texts are read from ``documents``.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    if dtype is None:
        dtype = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    folder = folder or Scratch(spark, "tokens").path("files")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_files(documents, tokenizer_path, end_id, folder, dtype, partitions), folder, dtype


def token_file_digest(documents: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    manifest, folder, dtype = build_token_files(documents, tokenizer_path, end_id)
    return read_files(manifest.repartition(F.col("part")), folder, dtype)
