"""Approximate nearest neighbours by collision counting over single projections.

Every block of vectors is projected on the axes of random rotations; each projection is one sorted array.
A query opens a window around its own projection on every array. The windows widen round by round, as if
all buckets were hashed anew with a larger width. A vector that falls into the windows of at least a
threshold of projections is verified by its exact distance. A query ends when it holds ``k`` verified
vectors within the radius that the windows stand for, or when its windows hold the whole block.

Axes of one rotation share out a vector's length exactly, so the count of its collisions tells its distance
more sharply than as many independent lines would. The threshold follows from the mean and deviation of that
count at the radius. Windows grow in large steps while the counts are far from those of a vector at the
radius, and in small steps near it, so that few farther vectors are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

LEAST_PROJECTIONS = 64  # as many as the vectors have components, but at least so many
WIDTH = 3.0  # of a window, in units of the radius: a vector at the radius is inside with probability 0.87
DEVIATIONS = 0.5  # the threshold lies so many deviations below the collisions expected at the radius
GROWTH = 1.05, 4.0  # of the radius from round to round, least and most
BLOCK_VALUES = 1_600_000  # components of a block: 25 000 vectors of 64
BLOCK_ROWS = 1_000, 25_000  # vectors of a block, least and most
QUERY_BLOCK = 20_000  # queries broadcast at once
QUERY_GROUP = 256  # queries that widen together: their counters take at most 256 x 25 000 x 4 bytes = 26 MB


def collision_threshold(dimension: int, projections: int, width: float = WIDTH, deviations: float = DEVIATIONS) -> int:
    """Collisions of a vector at the radius, less ``deviations`` deviations.

    Counts of independent lines would vary by p (1 - p) a line. Axes of one rotation vary less, as the squares
    of a vector's projections on all of them add up to its squared length.
    """
    half = width / 2
    near, density = math.erf(half / math.sqrt(2)), math.exp(-half * half / 2) / math.sqrt(2 * math.pi)
    shared = 2 * (half * density) ** 2 * min(1.0, projections / dimension)
    spread = max(near * (1 - near) - shared, 0.0)
    return max(1, math.floor(projections * near - deviations * math.sqrt(projections * spread)))


def growth_steps(projections: int, width: float, growth: tuple[float, float]) -> np.ndarray:
    """By the collisions of the k-th best vector so far: how far to widen, to reach the radius at which it would lie."""
    least, most = growth
    shares = [min(max(c / projections, 1e-9), 1 - 1e-9) for c in range(projections + 1)]
    return np.clip([width / 2 / NormalDist().inv_cdf((1 + share) / 2) for share in shares], least, most)


def lines(dimension: int, projections: int, seed: int) -> np.ndarray:
    """Axes of random rotations, as many rotations as needed, scaled so that a projection is as long as a unit normal's."""
    random, parts = np.random.default_rng([seed, dimension]), []
    for start in range(0, projections, dimension):
        axes = min(dimension, projections - start)
        parts.append(np.linalg.qr(random.standard_normal((dimension, axes)))[0] * math.sqrt(dimension))
    return np.concatenate(parts, axis=1)


class SortedProjections:
    """One block of vectors with a sorted array per line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.ids, self.vectors, self.axes = ids, vectors, axes
        projected = vectors @ axes
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(projected.T, self.order, axis=1)
        self.order = self.order.astype(np.int32)
        self.verified = 0  # exact distances so far

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, width: float = WIDTH, deviations: float = DEVIATIONS,
               growth: tuple[float, float] = GROWTH) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest verified vectors of each query: ids and distances, nearest first, ties by id.

        The queries widen their windows together, so that a round looks up all window edges of one
        projection at once; each query has its own radius and ends on its own.
        """
        rows, projections = len(self.ids), len(self.values)
        threshold = collision_threshold(self.vectors.shape[1], projections, width, deviations)
        steps = growth_steps(projections, width, growth)
        centres = queries @ self.axes
        at = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centres.T)], axis=1)
        low, high = at.copy(), at.copy()
        # The first windows hold about k entries each.
        near = np.take_along_axis(self.values.T, np.minimum(at + k, rows - 1), axis=0)
        radius = np.maximum(np.median(np.abs(near - centres), axis=1) * 2 / width, 1e-12)
        hits = np.zeros((len(queries), rows), dtype=np.int32)
        seen = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(queries)
        active = np.arange(len(queries))
        while len(active):
            half = (width * radius[active] / 2)[:, None]
            lower, upper = centres[active] - half, centres[active] + half
            new_low = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, lower.T)], axis=1)
            new_high = np.stack([np.searchsorted(v, c, side="right") for v, c in zip(self.values, upper.T)], axis=1)
            new_low, new_high = np.minimum(new_low, low[active]), np.maximum(new_high, high[active])
            ended, step = [], []
            for turn, q in enumerate(active.tolist()):
                edges = zip(self.order, new_low[turn].tolist(), low[q].tolist(), high[q].tolist(), new_high[turn].tolist())
                entries = [part for order, lo, old_lo, old_hi, hi in edges for part in (order[lo:old_lo], order[old_hi:hi])]
                fresh = np.bincount(np.concatenate(entries), minlength=rows)
                before = hits[q] < threshold
                hits[q] += fresh
                new = np.flatnonzero(before & (hits[q] >= threshold))
                if len(new):
                    new = new[self.ids[new] != query_ids[q]]  # not the query's own row
                    self.verified += len(new)
                    distance = np.sqrt(((self.vectors[new] - queries[q]) ** 2).sum(axis=1))
                    seen[q] = np.concatenate([seen[q][0], new]), np.concatenate([seen[q][1], distance])
                whole = (new_low[turn] == 0).all() and (new_high[turn] == rows).all()
                # The query's own row is among the best, so the k-th other one is the best but k.
                best = np.cumsum(np.bincount(hits[q], minlength=projections + 1)[::-1])
                step.append(steps[max(projections - int(np.searchsorted(best, k + 1)), 0)])
                ended.append(whole or np.count_nonzero(seen[q][1] <= radius[q]) >= k)
            low[active], high[active] = new_low, new_high
            radius[active] *= step
            active = active[~np.array(ended)]
        best = [np.lexsort((self.ids[found], distance))[:k] for found, distance in seen]
        return [(self.ids[found[b]], distance[b]) for b, (found, distance) in zip(best, seen)]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, vector`` (doubles) without null ids, null, empty or zero vectors and null or non-finite components."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
            .filter(F.forall("vector", sound) & F.exists("vector", lambda x: x != 0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, projections: int | None = None, width: float = WIDTH,
            deviations: float = DEVIATIONS, growth: tuple[float, float] = GROWTH, seed: int = 17,
            id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found per query by Euclidean distance.

    All rows of ``vectors`` are candidates but those with the query's own id. Queries go out in blocks of
    ``QUERY_BLOCK`` rows; each task indexes its own blocks of vectors, so nothing is sampled and no task
    holds more than a block. Without ``projections`` a block has one whole rotation, and more below
    ``LEAST_PROJECTIONS`` components. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without an id; vectors of another dimension than the query's are no candidates. Of
    several query rows with one id the smallest vector counts. Repeated rows are candidates each. Empty
    tables give an empty result; only the two named columns are read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    asked = usable(queries, id_column, vector_column).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    found = []
    for block in range(blocks):
        # At most about QUERY_BLOCK rows: a stated block of the query set.
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        sent = spark.sparkContext.broadcast((own["id"].to_numpy(dtype=np.int64), [np.asarray(v, dtype=np.float64) for v in own["vector"]]))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, query_vectors = sent.value
            for ids, matrix in _blocks(batches):
                axes = lines(matrix.shape[1], projections or max(matrix.shape[1], LEAST_PROJECTIONS), seed)
                index = SortedProjections(ids, matrix, axes)
                same = np.flatnonzero([len(v) == matrix.shape[1] for v in query_vectors])
                hits = []
                for start in range(0, len(same), QUERY_GROUP):
                    part = same[start:start + QUERY_GROUP]
                    found = index.search(query_ids[part], np.stack([query_vectors[i] for i in part]), k, width, deviations, growth)
                    hits += [(q, *pair) for q, pair in zip(query_ids[part].tolist(), found)]
                if hits:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat([q for q, _, _ in hits], [len(i) for _, i, _ in hits]).astype(np.int64)),
                        pa.array(np.concatenate([i for _, i, _ in hits]).astype(np.int64)),
                        pa.array(np.concatenate([d for _, _, d in hits]).astype(np.float64))], ["query_id", "vec_id", "score"])

        found.append(rows.mapInArrow(search, "query_id bigint, vec_id bigint, score double"))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionAll(more)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (everything.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of blocks of vectors of one dimension each."""
    held: dict[int, list] = {}
    least, most = BLOCK_ROWS

    def matrix(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts])

    for batch in batches:
        ids, column = batch.column(0).to_numpy(), batch.column(1)
        sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            part = (ids[rows], flat[starts[rows][:, None] + np.arange(size)])
            parts = held.setdefault(int(size), [])
            parts.append(part)
            if sum(len(i) for i, _ in parts) >= min(max(BLOCK_VALUES // int(size), least), most):
                yield matrix(held.pop(int(size)))
    for parts in held.values():
        yield matrix(parts)
