"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to small letters with one space between runs of letters; all n-grams of 1 to 3 signs of the
whole text are hashed and counted. Damped counts times inverse document frequencies, scaled to length one, enter
a linear model that is trained by follow-the-regularised-leader with an elastic-net penalty: the L1 part
leaves most weights at zero. Every fifth example is kept from the training and sets the temperature that the
margins are divided by, so that scores are calibrated probabilities.

The model is fitted on a bounded sample: at most ``FIT_ROWS`` documents of each of the ``MOST_LANGUAGES`` most
frequent languages. An example weighs as many rows as it stands for, so the bound does not change the
languages' shares. Each document is scored on its whole text.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from reqlens.llm.common import identified_texts, remainder

FIT_ROWS = 600  # labelled documents of each language at most
MOST_LANGUAGES = 200  # languages that are learned at most, the most frequent ones
HASH_BITS = 16
FEATURES = 8192  # hashed n-grams of the model at most, those of most sample texts
LEAST_ROWS = 3  # sample texts that a hashed n-gram must occur in
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
EPOCHS = 4
CALIBRATION = 5  # every fifth example is for the temperature
TEMPERATURES = (0.05, 20.0)
UNKNOWN = "und"
_BLOCK = 1 << 20  # signs folded at once
_DRAWS = 1 << 31


@functools.cache
def _letters() -> np.ndarray:
    """The small letter of each code point that is a letter, a space for all others."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    points = [p for p in range(sys.maxunicode + 1) if chr(p).isalpha()]
    table[points] = points
    return table


def folded(text: str) -> np.ndarray:
    """Code points of the text in small letters, other signs folded to one space, with a space at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    points = _letters()[points]
    space = points == 32
    space[1:] &= space[:-1].copy()
    space[0] = False
    return points[~space]


def hashed_counts(text: str, columns: np.ndarray, width: int) -> np.ndarray | None:
    """Counts of the text's n-grams by ``columns`` of their hashes; null without a letter.

    Long texts are hashed in blocks that overlap by two signs, so memory stays bounded and no n-gram is lost.
    """
    points = folded(text)
    if len(points) < 3:
        return None
    counts = np.zeros(width, dtype=np.int64)
    multiplier, shift = np.uint32(0x9E3779B1), np.uint32(32 - HASH_BITS)
    for start in range(0, len(points), _BLOCK):
        block = points[start:start + _BLOCK + 2]
        own = min(_BLOCK, len(points) - start)
        key = block * np.uint32(3)
        for order in range(3):
            if order:
                key = key[:-1] * np.uint32(1000003) + block[order:] + np.uint32(order)
            counts += np.bincount(columns[(key[:own] * multiplier) >> shift], minlength=width)
    return counts


@dataclass
class LanguageModel:
    """``columns`` holds the model's column of each hash, or the last column, which is none."""

    languages: list[str]
    columns: np.ndarray
    idf: np.ndarray
    weights: np.ndarray  # one row per column, the last one is the bias
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        counts = hashed_counts(text, self.columns, len(self.idf) + 1)
        return None if counts is None else scaled(counts[:-1], self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.vector(text) if text and self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        share = softmax(margins(*found, self.weights) / self.temperature)
        best = int(np.argmax(share))  # ties: the first language by name
        return self.languages[best], float(min(1.0, share[best]))


def scaled(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a TF-IDF vector of length one."""
    keys = np.flatnonzero(counts)
    values = (1 + np.log(counts[keys])) * idf[keys]
    return keys, values / (np.sqrt((values ** 2).sum()) or 1.0)


def margins(keys: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return values @ weights[keys] + weights[-1]


def softmax(margin: np.ndarray) -> np.ndarray:
    raised = np.exp(margin - margin.max())
    return raised / raised.sum()


def follow_the_leader(vectors: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, importance: np.ndarray, features: int,
                      classes: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal steps, one example at a time; the last row is the bias."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def leader(own_z: np.ndarray, own_n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(own_z) * np.maximum(np.abs(own_z) - l1, 0)
        return -shrunk / ((beta + np.sqrt(own_n)) / alpha + l2)

    for _ in range(epochs):
        for (keys, values), target, weight in zip(vectors, targets, importance):
            keys, values = np.append(keys, features), np.append(values, 1.0)
            own_z, own_n = z[keys], n[keys]
            weights = leader(own_z, own_n)
            error = softmax(values @ weights)
            error[target] -= 1
            slope = np.outer(values, error * weight)
            after = own_n + slope ** 2
            z[keys] = own_z + slope - (np.sqrt(after) - np.sqrt(own_n)) / alpha * weights
            n[keys] = after
    return leader(z, n)


def log_loss(margin: np.ndarray, targets: np.ndarray, importance: np.ndarray, temperature: float) -> float:
    heated = margin / temperature
    top = heated.max(axis=1)
    losses = top + np.log(np.exp(heated - top[:, None]).sum(axis=1)) - heated[np.arange(len(targets)), targets]
    return float(np.average(losses, weights=importance))


def calibrate(margin: np.ndarray, targets: np.ndarray, importance: np.ndarray) -> float:
    """The temperature of least log loss, by golden sections of its logarithm; 1 without examples."""
    if not len(targets):
        return 1.0
    low, high = np.log(TEMPERATURES)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(50):
        left, right = high - golden * (high - low), low + golden * (high - low)
        if log_loss(margin, targets, importance, np.exp(left)) <= log_loss(margin, targets, importance, np.exp(right)):
            high = right
        else:
            low = left
    return float(np.exp((low + high) / 2))


def sample(documents: DataFrame, divisor: int, held_out: int, rows: int) -> tuple[DataFrame, dict[str, int]]:
    """``lang, draw, text`` of at most ``rows`` documents of each learned language, and the languages' rows.

    The draw is a hash of id and text; rows equal in both count once. A language's rows are thinned by
    their draw before any shuffle, so the choice moves few rows whatever the table's size.
    """
    known = documents.select("doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), divisor) != held_out))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return known.select("lang", F.lit(0).cast("bigint").alias("draw"), "text").limit(0), counts
    # Twice the rows and a little more pass, so that fewer than ``rows`` do so by chance only once in many lifetimes.
    pairs = [F.lit(v) for lang, n in counts.items() for v in (lang, int(_DRAWS * min(1.0, (2 * rows + 100) / n)))]
    drawn = known.withColumn("draw", F.xxhash64("doc_id", "text"))
    thinned = drawn.filter(F.pmod("draw", F.lit(_DRAWS)) < F.element_at(F.create_map(*pairs), F.col("lang")))
    once = thinned.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(_DRAWS)), "draw"))
    return once.withColumn("turn", first).filter(F.col("turn") <= rows).drop("turn"), counts


def collect_counts(examples: DataFrame) -> pd.DataFrame:
    """``lang, draw, keys, counts`` of the bounded sample, in the order of the draw; texts stay with the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = np.arange(1 << HASH_BITS)
        for frame in frames:
            made = [hashed_counts(text, columns, len(columns)) for text in frame["text"]]
            keys = [None if m is None else np.flatnonzero(m) for m in made]
            yield pd.DataFrame({"lang": frame["lang"], "draw": frame["draw"],
                                "keys": [None if k is None else k.astype("<u2").tobytes() for k in keys],
                                "counts": [None if k is None else m[k].astype("<u4").tobytes() for k, m in zip(keys, made)]})

    made = examples.mapInPandas(run, "lang string, draw bigint, keys binary, counts binary").filter("keys is not null").toPandas()
    return made.sort_values(["draw", "lang"]).reset_index(drop=True)


def fit(documents: DataFrame, divisor: int = 3, held_out: int = 1, rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on at most ``rows`` documents of each language outside the held-out fold."""
    examples, totals = sample(documents, divisor, held_out, rows)
    made = collect_counts(examples)
    languages = sorted(set(made["lang"]))
    none = LanguageModel(languages, np.zeros(1 << HASH_BITS, dtype=np.int64), np.zeros(0), np.zeros((1, max(1, len(languages)))))
    if not languages:
        return none
    keys = [np.frombuffer(bytes(k), "<u2").astype(np.int64) for k in made["keys"]]
    counts = [np.frombuffer(bytes(c), "<u4").astype(np.int64) for c in made["counts"]]
    seen = np.bincount(np.concatenate(keys), minlength=1 << HASH_BITS)
    chosen = np.argsort(-seen, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[seen[chosen] >= min(LEAST_ROWS, len(keys))])
    columns = np.full(1 << HASH_BITS, len(chosen), dtype=np.int64)
    columns[chosen] = np.arange(len(chosen))
    idf = np.log((1 + len(keys)) / (1 + seen[chosen])) + 1
    vectors = []
    for own_keys, own_counts in zip(keys, counts):
        full = np.zeros(len(chosen) + 1, dtype=np.int64)
        full[columns[own_keys]] = own_counts
        vectors.append(scaled(full[:-1], idf))
    targets = np.searchsorted(languages, made["lang"].to_numpy(dtype=object)).astype(np.int64)
    sampled = np.bincount(targets, minlength=len(languages))
    stands_for = np.array([totals[lang] for lang in languages]) / sampled
    importance = (stands_for * sampled.sum() / (stands_for * sampled).sum())[targets]
    place = np.arange(len(targets))
    held = place % CALIBRATION == CALIBRATION - 1
    learn = np.flatnonzero(~held)
    weights = follow_the_leader([vectors[i] for i in learn], targets[learn], importance[learn], len(chosen), len(languages))
    rest = np.flatnonzero(held)
    margin = np.array([margins(*vectors[i], weights) for i in rest]).reshape(len(rest), len(languages))
    return LanguageModel(languages, columns, idf, weights, calibrate(margin, targets[rest], importance[rest]))


def identify(documents: DataFrame, divisor: int = 3, held_out: int = 1, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, over its whole text.

    ``lang_pred`` is one of the learned languages, ``score`` its calibrated probability. Null texts and texts without a letter give ``und``
    with score 0; so do all texts if no language could be learned. A text none of whose n-grams is known gets the
    most frequent language, by the bias. Ties go to the first language by name. ``held_out`` is
    null for null ids, which the fit does not read. Repeated rows are scored each and learned from once; an empty table
    gives an empty result. Very long texts are read in blocks. Only the text enters the score.
    """
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, divisor, held_out, rows))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            yield pd.DataFrame([model.predict(text) for text in texts], columns=["lang_pred", "score"])

    made = identified_texts(documents).withColumn("made", F.pandas_udf(run, "lang_pred string, score double")("text"))
    return made.select("doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "made.lang_pred", "made.score")
