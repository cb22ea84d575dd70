"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

Terms describe how a text is written (shapes of words, neighbouring shapes, bands of simple ratios) and,
with less weight, its words. A truncated singular value decomposition of the labelled texts gives the
latent space. The labelled vectors are broadcast; every document gets its exact cosine to all of them, in
blocks, and its nearest labelled texts vote. Where a class has more labelled rows than the sample takes, its
votes count for as many rows as each stands for, so the sample's bound does not change the shares of the classes.
"""

from __future__ import annotations

import itertools
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from reqlens.llm.common import identified_texts, remainder

FIT_ROWS = 3_000  # labelled rows of each class at most that the space and the votes are built from
SHAPE_TERMS, WORD_TERMS = 1024, 1024  # hashed terms of the two kinds
SHORT_WORD = 4  # words up to this length are terms: mostly function words
WORD_WEIGHT = 0.25
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.7
_BLOCK = 2048
_MEMO = 300_000


# Bytes of a text by kind: small letters (and all bytes of other scripts), capitals, digits; signs stay.
_KINDS = bytes(ord("a") if 97 <= b <= 122 or b > 127 else ord("A") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b
               for b in range(256))
_COLLAPSED = np.isin(np.arange(256), list(b"aA9"))


def _shapes(text: str) -> list[bytes]:
    """The words' shapes: a run of small letters, capitals or digits is one sign; signs stay."""
    kinds = np.frombuffer(text.encode("utf-8", "replace").translate(_KINDS), dtype=np.uint8)
    kept = np.ones(len(kinds), dtype=bool)
    kept[1:] = (kinds[1:] != kinds[:-1]) | ~_COLLAPSED[kinds[1:]]
    return [shape[:12] for shape in kinds[kept].tobytes().split()]


class Terms:
    """Hashed weighted terms of a text; remembers the numbers of terms seen, up to a bound."""

    def __init__(self):
        self.memo: dict = {}

    def _number(self, term) -> int:
        """Shapes and pairs of shapes share one range, short words have the other."""
        if isinstance(term, str):
            return SHAPE_TERMS + zlib.crc32(term.lower().encode()) % WORD_TERMS
        return zlib.crc32(term if isinstance(term, bytes) else b" ".join(term)) % SHAPE_TERMS

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights: logarithms of counts, each kind scaled to its share of the length."""
        words, shapes = text.split(), _shapes(text)
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, counts = self.memo, Counter(words)
        totals: dict[int, int] = {}
        for source in (Counter(shapes), Counter(zip(shapes, shapes[1:])), {w: n for w, n in counts.items() if len(w) <= SHORT_WORD}):
            for term, n in source.items():
                number = memo.get(term)
                if number is None:
                    number = memo[term] = self._number(term)
                totals[number] = totals.get(number, 0) + n
        total = len(words)
        if total:
            repeats = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
            for name, share in (("distinct", len(counts) / total), ("repeat", repeats / total),
                                ("top", max(counts.values()) / total)):
                number = zlib.crc32(f"{name} {round(share * 8)}".encode()) % SHAPE_TERMS
                totals[number] = totals.get(number, 0) + max(3, total // 4)
        keys = np.fromiter(totals.keys(), np.int64, len(totals))
        values = np.log1p(np.fromiter(totals.values(), np.float64, len(totals)))
        for kind, weight in ((keys < SHAPE_TERMS, 1.0), (keys >= SHAPE_TERMS, WORD_WEIGHT)):
            norm = np.sqrt((values[kind] ** 2).sum())
            if norm:
                values[kind] *= weight / norm
        return keys, values


@dataclass
class QualityModel:
    """Term weights, the basis of the latent space, and the labelled vectors with their labels and the rows each stands for."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray
    base_rate: float

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.basis.shape[1]), dtype=np.float32)
        for i, (keys, values) in enumerate(rows):
            if len(keys):
                out[i] = (values * self.idf[keys]) @ self.basis[keys]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, weighted by similarity and by the rows each stands for."""
        out = np.full(len(rows), self.base_rate)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(rows), _BLOCK):
            own = self.latent(rows[start:start + _BLOCK])
            cosine = own @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** 4 * self.stands_for[near]
            total = weight.sum(axis=1)
            voted = (weight * self.labels[near]).sum(axis=1)
            out[start:start + _BLOCK] = np.where(total > 0, voted / np.where(total > 0, total, 1), self.base_rate)
        return np.clip(out, 0.0, 1.0)


def known_labels(labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """``labelled_id, target`` outside the held-out fold; without null ids and labels other than 0 and 1, the larger label of an id."""
    return (labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("target"))
            .filter(F.col("target").isin(0, 1) & (remainder(F.col("labelled_id"), divisor) != held_out))
            .groupBy("labelled_id").agg(F.max("target").alias("target")))


def rows_for_each(labels: DataFrame, label: str, divisor: int, held_out: int, rows: int) -> np.ndarray:
    """By class, how many labelled ids of the whole fold one of at most ``rows`` chosen ids stands for."""
    counts = {r["target"]: r["count"] for r in known_labels(labels, label, divisor, held_out).groupBy("target").count().collect()}
    return np.array([max(1.0, counts.get(target, 0) / rows) for target in (0, 1)])


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, rows: int) -> DataFrame:
    """``doc_id, text, target`` of at most ``rows`` labelled documents of each class, outside the held-out fold.

    The choice is by a hash of the id. Null labels, ids and labels other than 0 and 1 take no part; of
    several rows with one id each text counts, with the larger label.
    """
    known = known_labels(labels, label, divisor, held_out)
    order = F.xxhash64("labelled_id", F.lit(7))
    chosen = (known.filter("target = 1").orderBy(order, "labelled_id").limit(rows)
              .unionAll(known.filter("target = 0").orderBy(order, "labelled_id").limit(rows)))
    # At most 2 * rows pairs of numbers, so the broadcast has a bound.
    texts = identified_texts(documents)
    return (texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["labelled_id"])
            .select("doc_id", "text", "target"))


def collect_terms(examples: DataFrame) -> tuple[list, np.ndarray]:
    """Terms of the bounded sample, made by the executors; texts stay there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for frame in frames:
            rows = [terms.of(text) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "keys": [k.astype("<i4").tobytes() for k, _ in rows],
                                "weights": [v.astype("<f8").tobytes() for _, v in rows], "target": frame["target"]})

    made = examples.mapInPandas(run, "doc_id bigint, keys binary, weights binary, target int").toPandas()
    made["keys"], made["weights"] = made["keys"].map(bytes), made["weights"].map(bytes)
    made = made.sort_values(["doc_id", "keys", "weights"])
    return ([(np.frombuffer(k, "<i4"), np.frombuffer(v, "<f8")) for k, v in zip(made["keys"], made["weights"])],
            made["target"].to_numpy(dtype=np.float64))


def fit(documents: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents per class; ids of the held-out fold are never read."""
    examples, targets = collect_terms(labelled_texts(documents, labels, "quality", divisor, held_out, rows))
    size = SHAPE_TERMS + WORD_TERMS
    if not len(targets):
        return QualityModel(np.ones(size), np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), targets, targets, 0.5)
    seen = np.zeros(size)
    for keys, _ in examples:
        seen[keys] += 1
    idf = np.log((1 + len(examples)) / (1 + seen)) + 0.2
    gram = np.zeros((size, size))
    for start in range(0, len(examples), 1000):
        dense = np.zeros((min(1000, len(examples) - start), size))
        for i, (keys, values) in enumerate(examples[start:start + 1000]):
            dense[i, keys] = values * idf[keys]
        gram += dense.T @ dense
    # Right singular vectors of the term matrix.
    _, vectors = np.linalg.eigh(gram)
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS], dtype=np.float32)
    stands_for = rows_for_each(labels, "quality", divisor, held_out, rows)[targets.astype(int)]
    model = QualityModel(idf, basis, np.zeros((0, 1), np.float32), targets, stands_for, float(np.average(targets, weights=stands_for)))
    model.vectors = model.latent(examples)
    return model


def score_column(model: QualityModel, text: Column, documents: DataFrame) -> Column:
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            yield pd.Series(sent.value.scores([terms.of(text) for text in texts]))

    return F.pandas_udf(run, "double")(text)


def score_documents(documents: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``score`` is the weighted share of label 1 among the neighbours, ``predicted`` is 1 from 0.7. Texts
    without words (null, empty, white space) and documents far from all labelled ones get the share of
    label 1 in the whole fold (0.5 without labels). ``held_out`` is null for null ids. Repeated rows
    are scored each; an empty table gives an empty result. Only the text enters the score.
    """
    texts = identified_texts(documents)
    model = fit(documents, labels, divisor, held_out, rows)
    return (texts.withColumn("score", score_column(model, F.col("text"), documents))
            .select("doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
