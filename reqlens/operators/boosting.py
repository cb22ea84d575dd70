"""Gradient boosting for several classes at once on categorical features, by histograms.

Spark encodes each feature as one byte and folds equal rows of the fitting sample, whose size ``tree_forecast``
bounds; what is left are a few bytes a row, on which the trees are grown in NumPy. Every round grows one tree per class on
the gradients of the softmax loss. A tree grows best-first: the leaf whose best split gains most is split
next. A split sends a set of levels to the left; levels are ordered by gradient over hessian, and the best
cut of that order is taken. A node's sums per level come from one count over its rows, or from its parent's
minus its sibling's. Scoring is a vectorised function over all rows of any table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LEVELS = 255  # codes of known levels; the last code stands for all others
UNKNOWN = 255
LEAST_HESSIAN = 1e-3
SMOOTHING = 10.0  # rows of no gradient added to each level where levels are ordered


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. ``to_left`` tells for each node and code the side."""

    feature: np.ndarray
    to_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def values(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        while True:
            feature = self.feature[node[rows]]
            rows, feature = rows[feature >= 0], feature[feature >= 0]
            if not len(rows):
                return self.value[node]
            at = node[rows]
            node[rows] = np.where(self.to_left[at, codes[rows, feature]], self.left[at], self.right[at])


@dataclass
class Boosted:
    """Baseline margins and, for each round, one tree per class."""

    baseline: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        out = np.tile(self.baseline, (len(codes), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.values(codes)
        return out

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Equal rows are scored once."""
        if not len(codes):
            return np.zeros((0, len(self.baseline)))
        rows = np.ascontiguousarray(codes).view(np.dtype((np.void, codes.shape[1])) if codes.shape[1] else np.uint8).ravel()
        _, first, back = np.unique(rows, return_index=True, return_inverse=True)
        return softmax(self.margins(codes[first]))[back]


def softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


class _Grower:
    """Grows trees over one table of codes; ``counts`` are the rows that each folded row stands for."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, leaves: int, least_rows: int, ridge: float):
        self.codes, self.counts, self.leaves, self.least_rows, self.ridge = codes, counts.astype(np.float64), leaves, least_rows, ridge
        self.width = int(codes.max(initial=0)) + 1
        self.flat = codes.astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * self.width

    def sums(self, rows: np.ndarray, gradients: np.ndarray, hessians: np.ndarray) -> np.ndarray:
        """Gradients, hessians and rows by feature and level: one count per sum over all features."""
        features = self.codes.shape[1]
        where = self.flat[rows].ravel()
        made = [np.bincount(where, weights=np.repeat(of[rows], features), minlength=features * self.width)
                for of in (gradients, hessians, self.counts)]
        return np.array(made).reshape(3, features, self.width)

    def best_split(self, sums: np.ndarray) -> tuple[float, int, np.ndarray] | None:
        """Gain, feature and levels that go left; ties to the first feature and the smallest set."""
        g, h, n = sums
        empty = n <= 0
        order = np.argsort(np.where(empty, np.inf, g / (np.maximum(h, 0) + SMOOTHING)), axis=1, kind="stable")
        left_g, left_h, left_n = (np.cumsum(np.take_along_axis(np.where(empty, 0, of), order, axis=1), axis=1) for of in (g, h, n))
        all_g, all_h, all_n = (of[:, -1:] for of in (left_g, left_h, left_n))
        right_g, right_h, right_n = all_g - left_g, all_h - left_h, all_n - left_n
        allowed = (left_n >= self.least_rows) & (right_n >= self.least_rows) & (left_h >= LEAST_HESSIAN) & (right_h >= LEAST_HESSIAN)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g ** 2 / (left_h + self.ridge) + right_g ** 2 / (right_h + self.ridge) - all_g ** 2 / (all_h + self.ridge)
        gain = np.where(allowed, gain, -np.inf)
        best = int(np.argmax(gain))
        feature, cut = divmod(best, self.width)
        if not gain[feature, cut] > 1e-10:
            return None
        to_left = np.zeros(UNKNOWN + 1, dtype=bool)
        to_left[order[feature, :cut + 1]] = True
        # Levels without rows here, and unknown ones, go with the larger side.
        absent = np.ones(UNKNOWN + 1, dtype=bool)
        absent[:self.width] = empty[feature]
        to_left[absent] = left_n[feature, cut] > right_n[feature, cut]
        return float(gain[feature, cut]), feature, to_left

    def grow(self, gradients: np.ndarray, hessians: np.ndarray, step: float) -> tuple[Tree, np.ndarray]:
        """The tree, and its value for each row."""
        rows = np.arange(len(self.codes))
        parts, sums = [rows], [self.sums(rows, gradients, hessians)]
        feature, to_left, left, right = [-1], [np.zeros(UNKNOWN + 1, dtype=bool)], [-1], [-1]
        waiting: list[tuple[float, int, int, np.ndarray]] = []

        def look(node: int) -> None:
            found = self.best_split(sums[node])
            if found is not None:
                heapq.heappush(waiting, (-found[0], node, found[1], found[2]))

        look(0)
        leaves = 1
        while waiting and leaves < self.leaves:
            _, node, split, sides = heapq.heappop(waiting)
            goes = sides[self.codes[parts[node], split]]
            halves = (parts[node][goes], parts[node][~goes])
            smaller = int(len(halves[1]) < len(halves[0]))
            own = self.sums(halves[smaller], gradients, hessians)
            pair = [own, sums[node] - own]
            children = [len(feature), len(feature) + 1]
            for side in (0, 1):
                parts.append(halves[side])
                sums.append(pair[side != smaller])
                feature.append(-1)
                to_left.append(np.zeros(UNKNOWN + 1, dtype=bool))
                left.append(-1)
                right.append(-1)
            feature[node], to_left[node], left[node], right[node] = split, sides, *children
            parts[node] = sums[node] = None
            leaves += 1
            for child in children:
                look(child)
        value, per_row = np.zeros(len(feature)), np.zeros(len(self.codes))
        for node, part in enumerate(parts):
            if part is not None:
                value[node] = -step * gradients[part].sum() / (hessians[part].sum() + self.ridge + 1e-15)
                per_row[part] = value[node]
        return Tree(np.array(feature), np.array(to_left), np.array(left), np.array(right), value), per_row


def fit(codes: np.ndarray, labels: np.ndarray, counts: np.ndarray, weights: np.ndarray, classes: int, rounds: int = 200, step: float = 0.08,
        leaves: int = 63, least_rows: int = 200, ridge: float = 0.0, early_rows: int | None = 10_000, patience: int = 10,
        validation: int = 10) -> Boosted:
    """Boost ``rounds`` rounds on folded rows: ``counts`` rows of each, of weight ``weights`` each.

    Where there are more than ``early_rows`` rows every ``validation``-th folded row, taken from the fit, decides when to stop: after
    ``patience`` rounds that do not lower its log loss.
    """
    importance = counts * weights
    shares = np.bincount(labels, weights=importance, minlength=classes)
    model = Boosted(np.log(np.maximum(shares / max(shares.sum(), 1e-300), 1e-12)))
    if not len(codes) or not codes.shape[1]:
        return model
    held = np.zeros(len(codes), dtype=bool)
    if early_rows is not None and counts.sum() > early_rows:
        held[validation - 1::validation] = True
    own, aside = np.flatnonzero(~held), np.flatnonzero(held)
    grower = _Grower(codes[own], counts[own], leaves, least_rows, ridge)
    truth = np.zeros((len(own), classes))
    truth[np.arange(len(own)), labels[own]] = 1
    margins, scored = np.tile(model.baseline, (len(own), 1)), np.tile(model.baseline, (len(aside), 1))
    best, since = np.inf, 0
    for _ in range(rounds):
        shares = softmax(margins)
        trees = []
        for k in range(classes):
            gradients = (shares[:, k] - truth[:, k]) * importance[own]
            hessians = shares[:, k] * (1 - shares[:, k]) * importance[own]
            tree, values = grower.grow(gradients, hessians, step)
            margins[:, k] += values
            trees.append(tree)
        model.rounds.append(trees)
        if len(aside):
            for k, tree in enumerate(trees):
                scored[:, k] += tree.values(codes[aside])
            likely = softmax(scored)[np.arange(len(aside)), labels[aside]]
            loss = -np.average(np.log(np.maximum(likely, 1e-15)), weights=importance[aside])
            since = 0 if loss < best - 1e-7 else since + 1
            best = min(best, loss)
            if since >= patience:
                break
    return model


# On Spark ----------------------------------------------------------------------


def level_codes(train: DataFrame, features: Sequence[str], limits: dict[str, int]) -> dict[str, list[str]]:
    """The known levels of each feature in alphabetical order: the most frequent ones, at most ``limits`` or ``LEVELS``."""
    levels = train.unpivot([], list(features), "feature", "level").where(F.col("level").isNotNull()).groupBy("feature", "level").count()
    known: dict[str, list[str]] = {}
    for name in features:
        # At most ``LEVELS`` rows for each feature.
        top = levels.where(F.col("feature") == name).orderBy(F.desc("count"), "level").limit(min(LEVELS, limits.get(name, LEVELS)))
        known[name] = sorted(row["level"] for row in top.collect())
    return known


def code_bytes(known: dict[str, list[str]]) -> Column:
    """One byte per feature: the place of the level, or ``UNKNOWN``; made inside the engine."""
    digits = []
    for name, levels in known.items():
        place = F.lit(UNKNOWN)
        if levels:
            table = F.map_from_arrays(F.lit(levels), F.lit([f"{i:02x}" for i in range(len(levels))]))
            place = F.coalesce(F.try_element_at(table, F.col(name)), F.lit(f"{UNKNOWN:02x}"))
        else:
            place = F.lit(f"{UNKNOWN:02x}")
        digits.append(place)
    return F.unhex(F.concat(*digits))


def folded_rows(train: DataFrame, codes: Column, label: Column) -> pd.DataFrame:
    """``codes, label, rows`` of the different rows of a bounded table, in their order."""
    made = train.select(codes.alias("codes"), label.cast("int").alias("label")).groupBy("codes", "label").agg(F.count(F.lit(1)).alias("rows"))
    frame = made.toPandas()
    frame["codes"] = frame["codes"].map(bytes)
    return frame.sort_values(["codes", "label"]).reset_index(drop=True)


def fit_table(train: DataFrame, codes: Column, label: Column, features: int, weights: np.ndarray, **options) -> Boosted:
    """Fit on a table whose size the caller bounds; ``weights`` are those of the classes."""
    frame = folded_rows(train, codes, label)
    matrix = np.frombuffer(b"".join(frame["codes"]), dtype=np.uint8).reshape(len(frame), features)
    labels = frame["label"].to_numpy(dtype=np.int64)
    # Folded rows in a hashed order, so that every tenth is a fair choice.
    order = np.argsort(pd.util.hash_pandas_object(frame["codes"].map(bytes.hex) + frame["label"].astype(str), index=False).to_numpy(), kind="stable")
    return fit(matrix[order], labels[order], frame["rows"].to_numpy(dtype=np.float64)[order], weights[labels][order], len(weights), **options)


def probability_column(model: Boosted, codes: Column, features: int, spark) -> Column:
    """Probabilities of all classes as an array."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch), dtype=np.uint8).reshape(len(batch), features)
            yield pd.Series(list(sent.value.probabilities(matrix)))

    return F.pandas_udf(run, "array<double>")(codes)
