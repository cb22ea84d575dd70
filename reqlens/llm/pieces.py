"""SentencePiece encoding and decoding by suffix-array matching.

A batch's different chunks (a run of spaces with the word behind it) are concatenated and indexed by
one suffix array, sorted as deep as the longest piece. Binary search finds for every piece of the
vocabulary the range of its occurrences. Each occurrence is an edge of the chunk's lattice; the edges
are sorted by their end and relaxed from left to right.

The model merges pairs by rank, so the path to take is not the one of the best sum. Relaxing uses an
exact rule instead: a piece may follow the last piece of the best path to its start only if the pair
itself stays apart when merged by rank. Exactly one edge into each position passes, since a sequence is
the merged form of its text just when every neighbouring pair of it is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from reqlens.llm.common import identified_texts
from reqlens.llm.tokenfiles import runs, slices

SPACE = "▁"
# These bound a worker's memory (about 250 MB in all); they do not change results.
_MEMO_CHUNKS = 150_000  # chunks of one generation of a worker's memory; it holds two
_BATCH_BYTES = 1_000_000  # of texts turned into strings at once, one text at least
_INDEX_CHARS = 50_000  # text under one suffix array, one chunk at least
_STATE: dict = {}


class PieceModel:
    """Vocabulary of a model file with tables for matching: sorted pieces, last merges, mergeable pairs."""

    def __init__(self, path: str):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = reader.get_piece_size()
        self.pieces = [reader.id_to_piece(i) for i in range(self.size)]
        special = [reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i) for i in range(self.size)]
        self.byte_ids = np.array([reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        normal = sorted((p, i) for i, p in enumerate(self.pieces) if not special[i] and not reader.is_unused(i))
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal):
            raise ValueError("a piece crosses the beginning of a word: chunks cannot be coded apart")
        ids = {p: i for p, i in normal}
        self.sorted_ids = np.array([i for _, i in normal], dtype=np.int32)
        self.lengths = np.array([len(p) for p, _ in normal], dtype=np.int32)
        self.depth = int(self.lengths.max())
        self.codes = np.zeros((len(normal), self.depth), dtype=np.uint32)
        for row, (p, _) in enumerate(normal):
            self.codes[row, :len(p)] = [ord(c) for c in p]
        # A sign that no piece has behind a letter begins a chunk of its own, as a space does.
        letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
        inner = {b for p in ids for a, b in zip(p, p[1:]) if letters.match(a)}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in inner)
        word = f"{letters.pattern}++(?=[{signs}])|[^ ]++" if signs else "[^ ]++"
        self.chunk = re.compile(f" *+(?:{word})| ++")
        # What each id spells; pieces of bytes spell that byte, control pieces nothing.
        self.spelling = [b"" if special[i] else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(self.pieces)]
        for byte, i in enumerate(self.byte_ids.tolist()):
            self.spelling[i] = bytes([byte])
        self.alphabet = np.sort(np.array([ord(p) for p in ids if len(p) == 1], dtype=np.uint32))
        # Rank of a piece: when it is merged; single characters are never merged.
        scores = {i: reader.get_score(i) for i in self.sorted_ids.tolist()}
        order = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: -scores[i])
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        pairs = [(ids[p[:k]] * self.size + ids[p[k:]], self.rank[i]) for p, i in ids.items()
                 for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        pairs.sort()
        self.pair_keys = np.array([key for key, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([rank for _, rank in pairs], dtype=np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        for p, i in ids.items():
            if len(p) > 1 and (split := self._last_merge(p, ids)):
                self.left[i], self.right[i] = split
            elif len(p) > 1:
                self.rank[i] = -2  # never the outcome of merging
        self.reachable = self.rank > -2

    def _last_merge(self, piece: str, ids: dict) -> tuple[int, int] | None:
        """The two parts merged last when the piece is built by rank."""
        parts = list(piece)
        while len(parts) > 2:
            found = min(((self.rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids),
                        default=None)
            if found is None:
                return None
            parts[found[1]:found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        return (ids[parts[0]], ids[parts[1]]) if all(p in ids for p in parts) else None

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that joins ``a`` and ``b``; a huge one where there is none."""
        keys = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a < self.size) & (b < self.size), self.pair_ranks[at], 1 << 40)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves ``a`` and ``b`` as they are when one follows the other.

        The merges inside both pieces are undone from the last to the first. At each moment the two
        pieces at the boundary must not be mergeable before the merge undone last; of equal ranks the
        left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        result = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), 1 << 39, dtype=np.int64)  # twice the rank; odd: equal ranks merge earlier here
        rank = lambda x: np.where(x < self.size, self.rank[np.minimum(x, self.size - 1)], -1)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            joined = 2 * self.pair_rank(x, y) < limit[live]
            result[live[joined]] = False
            rx, ry = rank(x), rank(y)
            going = ~joined & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            undo_left = rx > ry  # of equal pieces the right one is merged last
            limit[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            a[live] = np.where(undo_left, self.right[np.minimum(x, self.size - 1)], x)
            b[live] = np.where(undo_left, y, self.left[np.minimum(y, self.size - 1)])
        return result


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their first ``depth`` characters, by prefix doubling."""
    values, rank = np.unique(codes, return_inverse=True)
    rank, base, width = rank.astype(np.int64) + 1, len(values) + 1, 1
    if base ** 4 < 1 << 62:  # the first two doublings need no sorting
        longer = np.concatenate([rank, np.zeros(3, np.int64)])
        packed = ((longer[:-3] * base + longer[1:-2]) * base + longer[2:-1]) * base + longer[3:]
        order, width = np.argsort(packed, kind="stable"), 4
        ordered = packed[order]
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        if width >= depth:
            return order
    while True:
        behind = np.zeros_like(rank)
        behind[:-width or None] = rank[width:] if width < len(rank) else 0
        key = rank * (len(codes) + 1) + behind
        order = np.argsort(key, kind="stable")
        width *= 2
        if width >= depth:
            return order
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))


def occurrence_ranges(model: PieceModel, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the sorted vocabulary that occur, each with its range in the suffix array.

    ``codes`` are character codes plus one, zero for separators. One character after the other narrows
    all ranges at once by binary search.
    """
    padded = np.concatenate([codes, np.zeros(model.depth, codes.dtype)])
    rows = np.arange(len(model.lengths))
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
    done: list[tuple] = []
    for at in range(model.depth):
        wanted = model.codes[rows, at] + np.uint32(1)

        def bound(after: bool) -> np.ndarray:
            lo, hi = low.copy(), high.copy()
            for _ in range(int((hi - lo).max(initial=0)).bit_length()):
                open_ = lo < hi
                mid = (lo + hi) >> 1
                found = padded[order[np.minimum(mid, len(order) - 1)] + at]
                right = open_ & ((found <= wanted) if after else (found < wanted))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            return lo

        low, high = bound(False), bound(True)
        some = low < high
        rows, low, high = rows[some], low[some], high[some]
        ended = model.lengths[rows] == at + 1
        done.append((rows[ended], low[ended], high[ended]))
        rows, low, high = rows[~ended], low[~ended], high[~ended]
        if not len(rows):
            break
    return tuple(np.concatenate(column) for column in zip(*done))


def encode_chunks(model: PieceModel, chunks: list[str]) -> list[bytes]:
    """Ids of each chunk (no chunk is empty) as little-endian 32-bit integers."""
    joined = "\0".join(chunks) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").copy()
    codes[codes == 32] = ord(SPACE)
    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ends = starts + sizes
    # The separator must match nothing, and a zero character of a text is an unknown one.
    search = codes + np.uint32(1)
    search[ends] = 0
    order = suffix_array(search, model.depth)
    rows, low, high = occurrence_ranges(model, search, order)
    usable = model.reachable[model.sorted_ids[rows]]
    rows, low, high = rows[usable], low[usable], high[usable]
    many = high - low
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    where = order[np.repeat(low - first, many) + np.arange(many.sum())]
    ids = np.repeat(model.sorted_ids[rows], many).astype(np.int64)
    until = where + np.repeat(model.lengths[rows], many)
    # Characters outside the vocabulary are edges of their own, spelt in bytes later.
    known = np.isin(codes, model.alphabet)
    known[ends] = True
    strange = np.flatnonzero(~known)
    where, until = np.concatenate([where, strange]), np.concatenate([until, strange + 1])
    ids = np.concatenate([ids, model.size + codes[strange].astype(np.int64)])
    return _relax(model, codes, starts, sizes, where, until, ids)


def _relax(model: PieceModel, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
           where: np.ndarray, until: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Relax the edges in the order of their end within the chunk, all chunks at once; then walk back."""
    chunk = np.repeat(np.arange(len(starts)), sizes + 1)[where]
    end_at = until - starts[chunk]
    order = np.argsort(end_at.astype(np.uint16) if sizes.max() < 1 << 16 else end_at, kind="stable")  # short keys: radix
    where, until, ids, end_at = where[order], until[order], ids[order], end_at[order]
    begins = where == starts[chunk[order]]
    last = np.full(len(codes) + 1, -1, dtype=np.int64)  # last piece of the path to each position
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(end_at)) + 1, [len(end_at)]])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        before = np.where(begins[lo:hi], -1, last[where[lo:hi]])
        good = begins[lo:hi].copy()
        inner = np.flatnonzero(~good & (before >= 0))
        good[inner] = model.apart(before[inner], ids[lo:hi][inner])
        last[until[lo:hi][good]] = ids[lo:hi][good]
    length = np.ones(model.size, dtype=np.int64)
    length[model.sorted_ids] = model.lengths
    at, walkers, steps = starts + sizes, np.arange(len(starts)), []
    while len(walkers):
        piece = last[at[walkers]]
        steps.append((walkers, piece))
        at[walkers] -= np.where(piece < model.size, length[np.minimum(piece, model.size - 1)], 1)
        walkers = walkers[at[walkers] > starts[walkers]]
    counts = np.zeros(len(starts), dtype=np.int64)
    for who, _ in steps:
        counts[who] += 1
    ends = np.cumsum(counts)
    flat = np.zeros(ends[-1], dtype=np.int64)
    for step, (who, piece) in enumerate(steps, 1):
        flat[ends[who] - step] = piece
    spelt = np.zeros(len(starts), dtype=bool)
    spelt[np.searchsorted(ends, np.flatnonzero(flat >= model.size), side="right")] = True
    raw, bounds = flat.astype("<i4").tobytes(), (4 * np.concatenate([[0], ends])).tolist()
    coded = [raw[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]
    for k in np.flatnonzero(spelt).tolist():
        coded[k] = _spell(model, flat[ends[k] - counts[k]:ends[k]])
    return coded


def _spell(model: PieceModel, ids: np.ndarray) -> bytes:
    out: list[int] = []
    for i in ids.tolist():
        out.extend(model.byte_ids[list(chr(i - model.size).encode("utf-8"))].tolist() if i >= model.size else (i,))
    return np.array(out, dtype="<i4").tobytes()


class Codec:
    """Encodes and decodes texts; remembers chunks in two generations, the older of which is given up."""

    def __init__(self, path: str):
        self.model, self.memo, self.older = PieceModel(path), {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit integers."""
        split, memo = self.model.chunk.findall, self.memo
        chunked = [split(" " + text.replace(SPACE, " ")) if text else [] for text in texts]
        if len(memo) > _MEMO_CHUNKS:
            self.older, self.memo = memo, {}
            memo = self.memo
        new = []
        for chunk in set().union(*chunked).difference(memo):
            known = self.older.get(chunk)
            if known is None:
                new.append(chunk)
            else:
                memo[chunk] = known
        for start, stop in slices(new, _INDEX_CHARS):
            memo.update(zip(new[start:stop], encode_chunks(self.model, new[start:stop])))
        return [np.frombuffer(b"".join([memo[c] for c in chunks]), "<i4") for chunks in chunked]

    def decode(self, ids: Iterable[int]) -> str:
        """What the pieces spell, read as UTF-8, without the leading space."""
        spelling, size = self.model.spelling, self.model.size
        text = b"".join([spelling[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> Codec:
    """One per worker process."""
    if path not in _STATE:
        _STATE[path] = Codec(path)
    return _STATE[path]


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` for every document, over its whole text.

    Null and empty texts have no ids. ``round_trip`` says whether decoding the ids gives the text again;
    only the sign U+2581, which the model itself uses for spaces, comes back as a space. Repeated rows
    are coded each, null ids stay null, an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        for batch in batches:
            for start, stop in runs(pc.binary_length(batch.column(1)).to_pylist(), _BATCH_BYTES):
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                coded = coder.encode(texts)
                same = [coder.decode(ids.tolist()) == text.replace(SPACE, " ") for ids, text in zip(coded, texts)]
                offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in coded])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded).astype(np.int32))),
                    pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return identified_texts(documents).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode_column(ids: Column, model_path: str) -> Column:
    """Texts of id arrays; null arrays give null."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(model_path)
        for rows in batches:
            yield rows.map(lambda own: None if own is None else coder.decode(own.tolist()))

    return F.pandas_udf(run, "string")(ids)


def ids_digest(encoded: DataFrame) -> DataFrame:
    """Adds ``ids_crc32`` over the ids as little-endian 32-bit integers, and leaves the ids out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.asarray(own.values.to_numpy(zero_copy_only=False), dtype="<u4").tobytes())
                    for own in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), batch.column(3)],
                                             ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return encoded.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean")
