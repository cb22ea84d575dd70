"""Toxicity classifier that pays for changing its score when only an identity term changes.

A logistic model over the presence of hashed words and word beginnings. Every sentence of a labelled text that
names a group is copied once per name, with that one name exchanged for another one of its group; the squared
difference of the two scores is added to the loss. The weight of a group's name therefore shrinks, and neutral
mentions are not taken for abuse. Copies that lose and gain the same features are one pair with a count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reqlens.llm.common import identified_texts, remainder
from reqlens.llm.quality import labelled_texts

FIT_ROWS = 3_000  # labelled rows of each class at most that the model is fitted on
HASHED = 1 << 18  # numbers that words and word beginnings are hashed to
FEATURES = 3_000  # of them, the most telling ones of the sample
LEAST_ROWS = 4  # rows of the sample that a feature must occur in
BEGINNINGS = (4, 5)  # letters of a word's beginning that are features of their own
RIDGE, FAIRNESS, STEPS = 0.0003, 1.0, 400
THRESHOLD = 0.7
_MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")

# Groups of terms; a term is exchanged for the next one of its group. Other corpora pass groups of their own.
IDENTITY_TERMS = (
    ("he", "she"), ("him", "her"), ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("wife", "husband"), ("mother", "father"), ("daughter", "son"), ("sister", "brother"), ("feminist", "activist"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("gays", "straights", "lesbians"), ("transgender", "cisgender"),
    ("homosexual", "heterosexual"), ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"), ("islam", "christianity", "judaism", "hinduism"),
    ("black", "white", "asian", "latino", "hispanic"), ("blacks", "whites", "asians", "latinos", "hispanics"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"), ("africans", "europeans", "americans", "mexicans", "indians", "arabs"),
    ("immigrant", "native"), ("immigrants", "natives", "refugees"), ("old", "young"), ("elderly", "teenage"),
    ("disabled", "abled"), ("blind", "deaf"), ("poor", "rich"),
)


def exchanges(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {term: group[(k + 1) % len(group)] for group in groups for k, term in enumerate(group)}


class Features:
    """Distinct feature numbers of a text; remembers words seen, up to a bound."""

    def __init__(self, wanted: np.ndarray | None = None):
        """``wanted``: per hashed number the column of the model, or -1; without it all numbers count."""
        self.wanted, self.memo = wanted, {}

    def _numbers(self, word: str) -> tuple[int, ...]:
        keys = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]
        numbers = [zlib.crc32(key.encode()) % HASHED for key in keys]
        if self.wanted is not None:
            numbers = [int(self.wanted[n]) for n in numbers if self.wanted[n] >= 0]
        return tuple(numbers)

    def of(self, words: set[str]) -> np.ndarray:
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, found = self.memo, set()
        for word in words.difference(memo):
            memo[word] = self._numbers(word)
        for numbers in filter(None, map(memo.__getitem__, words)):
            found.update(numbers)
        return np.fromiter(found, np.int64, len(found))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def counterfactuals(text: str, swap: dict[str, str]) -> Iterator[tuple[set[str], set[str]]]:
    """The words of every sentence that names a group, before and after the exchange of one name."""
    for sentence in _SENTENCE_END.split(text):
        words = words_of(sentence)
        for term in words & swap.keys():
            yield words, words - {term} | {swap[term]}


@dataclass
class ToxicityModel:
    wanted: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterator[str], features: Features) -> np.ndarray:
        margins = np.array([self.bias + self.weights[features.of(words_of(text))].sum() for text in texts])
        return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def collect_features(examples: DataFrame, groups: tuple[tuple[str, ...], ...]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Feature numbers of the bounded sample, and its pairs: features lost, features gained, and how many copies do so."""
    swap = exchanges(groups)

    def packed(numbers: np.ndarray) -> bytes:
        return np.sort(numbers).astype("<i4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for frame in frames:
            pairs: Counter[tuple[bytes, bytes]] = Counter()
            for text in frame["text"]:
                for words, changed in counterfactuals(text, swap):
                    before, after = features.of(words), features.of(changed)
                    pairs[packed(np.setdiff1d(before, after)), packed(np.setdiff1d(after, before))] += 1
            own = [packed(features.of(words_of(text))) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "own": own, "target": frame["target"]}).reindex(
                columns=["doc_id", "own", "target", "lost", "gained", "copies"]).astype(object).where(lambda f: f.notna(), None)
            if pairs:
                yield pd.DataFrame([(None, None, None, *pair, count) for pair, count in pairs.items()],
                                   columns=["doc_id", "own", "target", "lost", "gained", "copies"], dtype=object)

    made = examples.mapInPandas(run, "doc_id bigint, own binary, target int, lost binary, gained binary, copies bigint").toPandas()
    for column in ("own", "lost", "gained"):
        made[column] = [None if b is None else bytes(b) for b in made[column]]
    texts = made.loc[made["own"].notna(), ["doc_id", "own", "target"]].sort_values(["doc_id", "own"]).reset_index(drop=True)
    pairs = made.loc[made["own"].isna()].groupby(["lost", "gained"], as_index=False)["copies"].sum()
    return texts, pairs


def fit(documents: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1, rows: int = FIT_ROWS,
        groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents per class; ids of the held-out fold are never read."""
    sample, pairs = collect_features(labelled_texts(documents, labels, "toxic", divisor, held_out, rows), groups)
    target = sample["target"].to_numpy(dtype=np.float64)
    wanted = np.full(HASHED, -1, dtype=np.int64)
    if not len(target) or target.min() == target.max():
        return ToxicityModel(wanted, np.zeros(1), 0.0 if not len(target) else float(8 * target[0] - 4))
    positive, negative = np.zeros(HASHED), np.zeros(HASHED)
    for own, label in zip(sample["own"], target):
        (positive if label else negative)[np.frombuffer(own, "<i4")] += 1
    n1, n0 = target.sum(), len(target) - target.sum()
    # The features whose shares of the two classes differ most, in standard deviations.
    shares = (positive + negative) / len(target)
    spread = np.sqrt(shares * (1 - shares) * (1 / n1 + 1 / n0)) + 1e-9
    telling = np.where(positive + negative >= LEAST_ROWS, np.abs(positive / n1 - negative / n0) / spread, -1)
    chosen = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
    chosen = chosen[telling[chosen] > 0]
    wanted[chosen] = np.arange(len(chosen))

    def matrix(rows_of_numbers: list) -> np.ndarray:
        out = np.zeros((len(rows_of_numbers), len(chosen)), dtype=np.float32)
        for row, numbers in enumerate(rows_of_numbers):
            columns = wanted[np.frombuffer(numbers, "<i4")]
            out[row, columns[columns >= 0]] = 1
        return out

    x = matrix(sample["own"].tolist())
    difference = matrix(pairs["gained"].tolist()) - matrix(pairs["lost"].tolist())
    copies = pairs["copies"].to_numpy(dtype=np.float32)
    copies /= max(1, copies.sum())
    weight = np.where(target == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)  # both classes count alike
    weights, bias, target = np.zeros(len(chosen), dtype=np.float32), np.float32(0), target.astype(np.float32)
    # Accelerated gradient steps; their length comes from the largest curvature, by power iteration.
    towards = np.ones(len(chosen) + 1, dtype=np.float32)
    for _ in range(20):
        towards /= np.linalg.norm(towards)
        inner = weight * (x @ towards[:-1] + towards[-1])
        towards = np.float32(0.25) * np.append(x.T @ inner, inner.sum())
    step = np.float32(1) / np.float32(1.1 * np.linalg.norm(towards) + RIDGE + fairness * 2 * float((difference ** 2).sum(axis=1).max(initial=0)))
    ridge, fair = np.float32(RIDGE), np.float32(2 * fairness)
    ahead, ahead_bias, momentum = weights, bias, 1.0
    for _ in range(STEPS):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -40, 40))) - target)
        slope = x.T @ error + ridge * ahead
        if len(copies):
            slope = slope + fair * (difference.T @ (copies * (difference @ ahead)))
        new, new_bias = ahead - step * slope, ahead_bias - step * error.sum()
        faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        onward = np.float32((momentum - 1) / faster)
        ahead, ahead_bias = new + onward * (new - weights), new_bias + onward * (new_bias - bias)
        weights, bias, momentum = new, new_bias, faster
    return ToxicityModel(wanted, weights.astype(np.float64), float(bias))


def score_documents(documents: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1, rows: int = FIT_ROWS,
                    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``score`` is the probability of label 1, ``predicted`` is 1 from 0.7. Texts without words (null,
    empty) get the score of no features; without labels of both classes all scores are alike. ``held_out``
    is null for null ids. Repeated rows are scored each; an empty table gives an empty result. Only the
    text enters the score.
    """
    model = fit(documents, labels, divisor, held_out, rows, groups, fairness)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(sent.value.wanted)
        for texts in batches:
            yield pd.Series(sent.value.scores(texts, features), dtype=np.float64)

    return (identified_texts(documents).withColumn("score", F.pandas_udf(run, "double")("text"))
            .select("doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
