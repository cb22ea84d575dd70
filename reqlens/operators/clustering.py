"""K-means of sparse vectors for many families and many starts at once.

A round is one job for all of them: every task assigns its points to the nearest centre of each start and sums them by
(family, start, cluster); the sums are combined by key, and only centres reach the driver. Rounds read the points without
their texts, and leave out the starts that stand still. Centres are chosen by k-means++, as a race: a
point's finishing time is exponential with its weight times its squared distance as rate, drawn from a hash of
its key, and the first one becomes a centre. So starts do not depend on how points are spread.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reqlens.session import cut_lineage

BLOCK = 128  # points made dense at once
DIGITS = 9  # distances are compared to so many digits; ties go to the first cluster
STILL = 1e-20  # squared; what sums in another order move a centre by is far below, what one point moves it by far above
POINTS = "family string, point string, weight double, keys binary, numbers binary"
NARROW = "family string, hash bigint, weight double, keys binary, numbers binary"
Centres = Mapping[str, np.ndarray]  # family -> starts x clusters x width


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the cells of a binary column in one array, and how many each cell has."""
    column, size = column.cast(pa.large_binary()), np.dtype(kind).itemsize
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "<i8")[column.offset:column.offset + len(column) + 1]
    numbers = np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0]) if ends[-1] > ends[0] else np.zeros(0, kind)
    return numbers, np.diff(ends) // size


def dense_blocks(batches: Iterator[pa.RecordBatch], widths: Mapping[str, int]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Points of one family with their dense vectors and squared lengths, in blocks; the vectors are good until the next block."""
    room = np.zeros(BLOCK * max(widths.values(), default=0))
    for batch in batches:
        families = batch.column("family").dictionary_encode()
        codes = families.indices.to_numpy(zero_copy_only=False)
        for code, family in enumerate(families.dictionary.to_pylist()):
            if family not in widths:
                continue
            own = batch if len(families.dictionary) == 1 else batch.take(pa.array(np.flatnonzero(codes == code)))
            (keys, sizes), (numbers, _) = _flat(own.column("keys"), "<i4"), _flat(own.column("numbers"), "<f8")
            ends, width = np.concatenate([[0], np.cumsum(sizes)]), widths[family]
            for start in range(0, len(own), BLOCK):
                part = own.slice(start, BLOCK)
                rows, cells = np.repeat(np.arange(len(part)), sizes[start:start + BLOCK]), slice(ends[start], ends[start + len(part)])
                at = rows * width + keys[cells]
                room[at] = numbers[cells]
                yield family, part, room[:len(part) * width].reshape(len(part), width), np.bincount(rows, weights=numbers[cells] ** 2, minlength=len(part))
                room[at] = 0


def squared_distances(points: np.ndarray, lengths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Points (with their squared lengths) by starts by clusters."""
    starts, clusters, width = centres.shape
    flat = centres.reshape(starts * clusters, width)
    made = lengths[:, None] - 2 * (points @ flat.T) + (flat ** 2).sum(axis=1)[None, :]
    return np.maximum(np.round(made, DIGITS), 0).reshape(len(points), starts, clusters)


def _hashes(points: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(points, categorize=False)


def finishing_times(points: pd.Series, rates: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Points by starts: exponential times of the given rates, from a hash of the point, the start and the step."""
    return _times(_hashes(points.to_numpy(dtype=object)), rates, seed, step)


def _times(base: np.ndarray, rates: np.ndarray, seed: int, step: int) -> np.ndarray:
    out = np.empty(rates.shape)
    for start in range(rates.shape[1]):
        mixed = base ^ np.uint64((seed * 1_000_003 + step * 10_007 + start + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # Fixed values: a mixing function of 64 bits
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        uniform = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        out[:, start] = -np.log(uniform) / (rates[:, start] + 1e-300)
    return out


def narrowed(points: DataFrame) -> DataFrame:
    """The points with a hash in place of their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hashes(batch.column("point").to_numpy(zero_copy_only=False)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("family"), pa.array(hashes), *[batch.column(c) for c in ("weight", "keys", "numbers")]],
                names=["family", "hash", "weight", "keys", "numbers"])

    return points if "hash" in points.columns else points.mapInArrow(run, NARROW)


def _next_centres(points: DataFrame, centres: Centres, sizes: Mapping[str, tuple[int, int]], starts: int, seed: int, step: int) -> DataFrame:
    """``family, start, keys, numbers``: the point that wins each race; of points with one time the one with the least hash."""
    widths = {family: width for family, (_, width) in sizes.items()}
    sent = points.sparkSession.sparkContext.broadcast(dict(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], tuple[float, int, bytes, bytes]] = {}
        for family, part, dense, lengths in dense_blocks(batches, widths):
            rates = np.repeat(part.column("weight").to_numpy()[:, None], starts, axis=1)
            if family in sent.value:
                rates = rates * squared_distances(dense, lengths, sent.value[family]).min(axis=2)
            hashes = part.column("hash").to_numpy()
            times = _times(hashes.view(np.uint64), rates, seed, step)
            for start, least in enumerate(times.min(axis=0)):
                first = np.flatnonzero(times[:, start] == least)
                at = int(first[hashes[first].argmin()])
                time = (float(least), int(hashes[at]))
                if (family, start) not in best or time < best[family, start][:2]:
                    best[family, start] = (*time, part.column("keys")[at].as_py(), part.column("numbers")[at].as_py())
        yield pa.RecordBatch.from_pylist([
            dict(zip(("family", "start", "time", "hash", "keys", "numbers"), (*key, *found))) for key, found in best.items()], pa.schema(
            [("family", pa.string()), ("start", pa.int32()), ("time", pa.float64()), ("hash", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())]))

    made = points.mapInArrow(run, "family string, start int, time double, hash bigint, keys binary, numbers binary")
    return made.groupBy("family", "start").agg(F.min_by(F.struct("keys", "numbers"), F.struct("time", "hash")).alias("won")).select(
        "family", "start", "won.*")


def first_centres(points: DataFrame, sizes: Mapping[str, tuple[int, int]], starts: int, seed: int) -> dict[str, np.ndarray]:
    """k-means++ for all families and starts: one job per cluster number. ``sizes`` holds clusters and width of each family."""
    points = narrowed(points)
    centres: dict[str, np.ndarray] = {}
    for step in range(max((k for k, _ in sizes.values()), default=0)):
        open_sizes = {family: size for family, size in sizes.items() if size[0] > step}
        won: dict[str, np.ndarray] = {family: np.zeros((starts, 1, width)) for family, (_, width) in open_sizes.items()}
        for row in _next_centres(points, centres, open_sizes, starts, seed, step).collect():
            won[row["family"]][row["start"], 0, np.frombuffer(bytes(row["keys"]), "<i4")] = np.frombuffer(bytes(row["numbers"]), "<f8")
        for family, made in won.items():
            centres[family] = np.concatenate([centres[family], made], axis=1) if family in centres else made
    return centres


def one_round(points: DataFrame, centres: Centres) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """New centres, and the inertia of the given ones by start. A cluster without points keeps its centre."""
    widths = {family: made.shape[2] for family, made in centres.items()}
    sent = points.sparkSession.sparkContext.broadcast(dict(centres))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        room: dict[str, np.ndarray] = {}
        for family, part, dense, lengths in dense_blocks(batches, widths):
            own = sent.value[family]
            starts, clusters, width = own.shape
            distance = squared_distances(dense, lengths, own)
            nearest = distance.argmin(axis=2)
            weight = part.column("weight").to_numpy()
            member = np.zeros((len(part), starts * clusters))
            inertia = np.zeros(starts * clusters)
            for start in range(starts):
                member[np.arange(len(part)), start * clusters + nearest[:, start]] = weight
                inertia[start * clusters] = weight @ distance[np.arange(len(part)), start, nearest[:, start]]
            if family not in sums:
                sums[family], room[family] = np.zeros((starts * clusters, width + 2)), np.empty((starts * clusters, width))
            sums[family][:, :width] += np.matmul(member.T, dense, out=room[family])
            sums[family][:, width] += member.sum(axis=0)
            sums[family][:, width + 1] += inertia
        yield _rows((family, slot, row) for family, made in sums.items() for slot, row in enumerate(made))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for family, slot, numbers in zip(*(batch.column(c).to_pylist() for c in ("family", "slot", "numbers"))):
                sums[family, slot] = sums.get((family, slot), 0) + np.frombuffer(numbers, "<f8")
        yield _rows((*key, made) for key, made in sums.items())

    schema = "family string, slot int, numbers binary"
    needed = points.select("family", "weight", "keys", "numbers")
    rows = needed.mapInArrow(partial, schema).repartition("family", "slot").mapInArrow(combine, schema).collect()
    sent.unpersist()
    after = {family: made.copy() for family, made in centres.items()}
    inertia = {family: np.zeros(made.shape[0]) for family, made in centres.items()}
    for row in rows:
        numbers = np.frombuffer(bytes(row["numbers"]), "<f8")
        start, cluster = divmod(row["slot"], centres[row["family"]].shape[1])
        if numbers[-2] > 0:
            after[row["family"]][start, cluster] = numbers[:-2] / numbers[-2]
        inertia[row["family"]][start] += numbers[-1]
    return after, inertia


def _rows(rows) -> pa.RecordBatch:
    families, slots, numbers = [*zip(*((family, slot, made.astype("<f8").tobytes()) for family, slot, made in rows))] or ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(families, pa.string()), pa.array(slots, pa.int32()), pa.array(numbers, pa.binary())], names=["family", "slot", "numbers"])


def best_centres(points: DataFrame, sizes: Mapping[str, tuple[int, int]], starts: int = 10, seed: int = 42, iterations: int = 50,
                 tolerance: float = 1e-6) -> dict[str, np.ndarray]:
    """Centres (clusters by width) of the start with the least inertia for each family; ties go to the first start.

    Rounds end when no centre of any start moved by more than ``tolerance`` (squared), at latest after ``iterations``.
    A start whose centres stand still would give the same sums again, so later rounds leave it out.
    """
    points = cut_lineage(narrowed(points))
    centres = first_centres(points, sizes, starts, seed)
    inertia = {family: np.zeros(starts) for family in centres}
    moving = {family: np.arange(starts) for family in centres}
    for turn in range(iterations + 1):
        after, found = one_round(points, {family: centres[family][own] for family, own in moving.items()})
        for family, own in moving.items():
            inertia[family][own] = found[family]
        moved = {family: ((after[family] - centres[family][own]) ** 2).sum(axis=2).max(axis=1) for family, own in moving.items()}
        if turn == iterations or max((float(m.max()) for m in moved.values()), default=0.0) <= tolerance:
            break
        for family, own in list(moving.items()):
            going = moved[family] > STILL
            centres[family][own[going]] = after[family][going]
            moving[family] = own[going]
            if not len(moving[family]):
                del moving[family]
    return {family: made[int(np.argmin(np.round(inertia[family], DIGITS)))] for family, made in centres.items()}


def assign(points: DataFrame, centres: Mapping[str, np.ndarray]) -> DataFrame:
    """``family, point, weight, cluster``: the nearest centre of each point, the first one on ties; families without centres are left out."""
    sent = points.sparkSession.sparkContext.broadcast({family: made[None] for family, made in centres.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for family, part, dense, lengths in dense_blocks(batches, {f: made.shape[2] for f, made in sent.value.items()}):
            nearest = squared_distances(dense, lengths, sent.value[family])[:, 0].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("family", "point", "weight")], pa.array(nearest)],
                                             names=["family", "point", "weight", "cluster"])

    return points.mapInArrow(run, "family string, point string, weight double, cluster bigint")
