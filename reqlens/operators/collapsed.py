"""Linear and logistic models of categorical features over collapsed rows.

All features are categories, so rows with equal features fold into one row with sums by a group-by that combines on
the map side. The table of folded rows grows with the variety of the features. Every pass of a fit is then one
aggregate over pairs of levels: each task adds up its own folded rows in arrays and gives one row per pair of levels.
These sums of products are what the normal equations or a Newton step need, and only they reach the driver. All rows
count, and nothing depends on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from reqlens.session import cut_lineage

ROWS = "_n"
INTERCEPT = "(intercept)"
RANK_TOLERANCE = 1e-10


@dataclass
class Design:
    """Folded rows with ``_terms``, the numbers of their columns; column 0 is the intercept."""

    rows: DataFrame
    names: list[tuple[str, str]]  # feature and level of column 1, 2, ...

    def score(self, coefficients: np.ndarray) -> Column:
        """The linear predictor of a row; ``coefficients`` begin with the intercept."""
        table = F.lit([float(c) for c in coefficients])
        return F.aggregate("_terms", F.lit(0.0), lambda total, term: total + F.get(table, term))


def collapse(df: DataFrame, features: Sequence[str], sums: Mapping[str, Column]) -> Design:
    """Fold rows with equal features; the alphabetically first level of each feature has no column.

    Features must not be null. The levels of all features, a few hundred, are model state on the driver.
    """
    return collapse_parts(df, features, {"all": (F.lit(True), sums)})["all"]


def collapse_parts(df: DataFrame, features: Sequence[str], parts: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> dict[str, Design]:
    """``collapse`` for several models in one pass over the rows: per model a condition on its rows, and its sums."""
    folded = cut_lineage(df.groupBy(*[F.col(f).cast("string").alias(f) for f in features]).agg(*[
        total for name, (kept, sums) in parts.items() for total in (
            F.count_if(kept).alias(f"{ROWS}_{name}"), *[F.sum(F.when(kept, value)).alias(f"{ROWS}_{name}_{of}") for of, value in sums.items()])]))
    return {name: _design(folded.where(F.col(f"{ROWS}_{name}") > 0).select(
        *features, F.col(f"{ROWS}_{name}").alias(ROWS), *[F.col(f"{ROWS}_{name}_{of}").alias(of) for of in sums]), features)
        for name, (_, sums) in parts.items()}


def _design(folded: DataFrame, features: Sequence[str]) -> Design:
    levels = folded.unpivot([], list(features), "feature", "level").distinct().collect()
    names = [(f, level) for f in features for level in sorted(r["level"] for r in levels if r["feature"] == f)[1:]]
    terms = [F.lit(0)]
    for feature in features:
        own = {level: i for i, (name, level) in enumerate(names, 1) if name == feature}
        if own:
            terms.append(F.try_element_at(F.map_from_arrays(F.lit(list(own)), F.lit(list(own.values()))), F.col(feature)))
    return Design(cut_lineage(folded.withColumn("_terms", F.array_compact(F.array(*terms)))), names)  # looked up once, not in every pass


def cross_sums(design: Design, weight: Column, response: Column) -> DataFrame:
    """``left, right, weight, response``: sums over the folded rows that have both columns, ``left <= right``."""
    rows = design.rows.select("_terms", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in (("_w", weight), ("_r", response))])
    pairs = rows.mapInArrow(_pair_sums(len(design.names) + 1), "left int, right int, weight double, response double")
    return pairs.groupBy("left", "right").agg(F.sum("weight").alias("weight"), F.sum("response").alias("response"))


def _pair_sums(size: int) -> Callable:
    """Sums per pair of columns over the rows of a task: ``size`` squared numbers, as many as the driver's matrix has."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen, weights, responses = np.zeros(size * size, dtype=np.int64), np.zeros(size * size), np.zeros(size * size)
        for batch in batches:
            terms = batch.column(0)
            flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            w, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            for step in range(int(lengths.max(initial=0))):  # each term with the one ``step`` places behind it in its row
                left, right = slice(0, len(flat) - step), slice(step, len(flat))
                same = row[left] == row[right]
                pair, at = (flat[left] * size + flat[right])[same], row[left][same]
                seen += np.bincount(pair, minlength=size * size)
                weights += np.bincount(pair, weights=w[at], minlength=size * size)
                responses += np.bincount(pair, weights=r[at], minlength=size * size)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array((found // size).astype(np.int32)), pa.array((found % size).astype(np.int32)), pa.array(weights[found]), pa.array(responses[found])],
            names=["left", "right", "weight", "response"])
    return run


def _matrices(design: Design, weight: Column, response: Column) -> tuple[np.ndarray, np.ndarray]:
    size = len(design.names) + 1
    products, towards = np.zeros((size, size)), np.zeros(size)
    frame = cross_sums(design, weight, response).toPandas()
    left, right = frame["left"].to_numpy(dtype=int), frame["right"].to_numpy(dtype=int)
    products[left, right] = products[right, left] = frame["weight"]
    with_intercept = left == 0
    towards[right[with_intercept]] = frame["response"][with_intercept]
    return products, towards


def least_squares(design: Design, total: str, squares: str) -> tuple[np.ndarray, float, int]:
    """Coefficients (intercept first), R squared and rows of the linear model of the value summed in ``total``.

    Solved from the normal equations of the centred columns; where columns depend on each other, the
    solution of least length is taken. Without variance R squared is null.
    """
    products, towards = _matrices(design, F.col(ROWS), F.col(total))
    count = products[0, 0]
    if not count:
        return np.zeros(len(towards)), float("nan"), 0
    mean_x, mean_y = products[0, 1:] / count, towards[0] / count
    centred = products[1:, 1:] - count * np.outer(mean_x, mean_x)
    with_y = towards[1:] - count * mean_x * mean_y
    slopes = np.linalg.lstsq(centred, with_y, rcond=RANK_TOLERANCE)[0] if len(with_y) else with_y
    whole = float(design.rows.agg(F.sum(squares)).first()[0]) - count * mean_y ** 2
    left = whole - 2 * slopes @ with_y + slopes @ centred @ slopes
    return np.append(mean_y - mean_x @ slopes, slopes), 1 - left / whole if whole > 0 else float("nan"), int(count)


def logistic(design: Design, positives: str, strength: float = 1.0, iterations: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients (intercept first) of the logistic model with a ridge of ``1 / strength`` on all but the intercept.

    Newton steps, each one aggregate over the folded rows, shortened where they would overshoot.
    """
    ridge = np.full(len(design.names) + 1, 1.0 / strength)
    ridge[0] = 0.0
    current = np.zeros(len(ridge))
    for _ in range(iterations):
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(-design.score(current)))
        curved, slope = _matrices(design, F.col(ROWS) * share * (F.lit(1.0) - share), F.col(positives) - F.col(ROWS) * share)
        if not curved[0, 0]:
            break
        step = np.linalg.lstsq(curved + np.diag(ridge), slope - ridge * current, rcond=None)[0]
        longest = np.abs(step).max()
        current = current + step * min(1.0, 3.0 / max(longest, 1e-300))
        if longest < tolerance:
            break
    return current


def area_under_curve(design: Design, coefficients: np.ndarray, positives: str) -> float:
    """Area under the ROC curve over all rows; ties count half. One row per different score is ordered, by ranges."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = design.rows.select(design.score(coefficients).alias("rawPrediction"), F.col(positives).alias("_pos"), F.col(ROWS).alias("_all"))
    sides = F.array(F.struct(F.lit(1.0).alias("label"), F.col("_pos").cast("double").alias("weight")),
                    F.struct(F.lit(0.0).alias("label"), (F.col("_all") - F.col("_pos")).cast("double").alias("weight")))
    rows = scored.select("rawPrediction", F.explode(sides).alias("s")).select("rawPrediction", "s.*").where("weight > 0")
    return BinaryClassificationEvaluator(numBins=0, weightCol="weight").evaluate(rows)


def term_name(design: Design, term: Column) -> Column:
    return F.get(F.lit([INTERCEPT, *[f"{feature}={level}" for feature, level in design.names]]), term)


def normal_equations(design: Design, total: str) -> DataFrame:
    """``left_term, right_term, rows, total`` by name: what ``least_squares`` solves; ``total`` only beside the intercept."""
    sums = cross_sums(design, F.col(ROWS), F.col(total))
    named = sums.select(term_name(design, F.col("left")).alias("a"), term_name(design, F.col("right")).alias("b"), "weight", "response")
    beside = reduce(lambda x, y: x | y, [F.col(c) == INTERCEPT for c in ("a", "b")])
    return named.select(F.least("a", "b").alias("left_term"), F.greatest("a", "b").alias("right_term"),
                        F.col("weight").cast("bigint").alias("rows"), F.when(beside, F.col("response")).alias("total"))
