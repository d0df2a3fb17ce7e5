"""Centroid clustering with Elkan's bounds, exact in its results.

Components are quantised to integers, so squared distances are exact integers; the bounds are floating numbers that are
rounded away from any wrong decision. Each vector keeps, from round to round, an upper bound of its distance to its own
centroid and a lower bound of its distance to each of the k centroids; when centroids move, the bounds give way by as
much (triangle inequality). A distance is worked out only where no bound proves the centroid strictly farther: the upper
bound is under the lower one, or under half the distance between the two centroids. As both tests are strict, a tie
is never pruned, and ties go to the smaller number by comparing integers.

A round is one pass over the vectors' partitions, which writes the vectors with their new bounds, and one sum for each
cluster, added up in the tasks first. The driver holds the k centroids, whose size the parameters bound.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from millrace.llm.storage import discard, materialise
from millrace.llm.topk import quantised

#: Differences under this have squares whose sums over 2^12 components are exact in 64 bits.
_NARROW = 1 << 25
#: Sums leave the tasks in digits of so many bits, which Spark's longs can add up for 2^31 tasks.
_DIGIT = 31
_MOST = (1 << 63) - 1


def squared(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to one centroid, or each to its own."""
    if values.dtype == object or centroids.dtype == object or values.shape[1] > 1 << 12 or max(np.abs(values).max(initial=0), np.abs(centroids).max(initial=0)) >= _NARROW:
        values, centroids = values.astype(object), centroids.astype(object)
    step = values - centroids
    return (step * step).sum(axis=1) if step.shape[1] else np.zeros(len(step), values.dtype)


def _root(square: int, up: bool) -> float:
    """A float that is not under (or not over) the root of an integer of any size."""
    try:
        x = float(math.isqrt(int(square)))
    except OverflowError:
        return math.inf if up else sys.float_info.max
    x = math.nextafter(x, math.inf if up else 0.0)
    return math.nextafter(x + 1.0, math.inf) if up else max(0.0, x)


def roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Roots of exact squares, rounded up or down by more than a float's error."""
    if squares.dtype == object:
        return np.array([_root(x, up) for x in squares], np.float64)
    near = np.sqrt(squares.astype(np.float64))
    # the square is off by half a unit when turned to a float, its root by another half
    return near * (1 + 2.0**-50) if up else near * (1 - 2.0**-50)


class Centroids:
    """k centroids (exact integers), the distances between them, and how far each has moved, safely rounded."""

    def __init__(self, exact: list[list[int]], before: list[list[int]] | None = None):
        self.exact = exact
        wide = any(abs(x) >= 1 << 62 for c in exact for x in c)
        self.values = np.array(exact, object if wide else np.int64).reshape(len(exact), len(exact[0]) if exact else 0)
        distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        self.half = np.array([[_root(distance(a, b), False) / 2 for b in exact] for a in exact], np.float64).reshape(len(exact), len(exact))
        np.fill_diagonal(self.half, math.inf)
        self.moved = np.array([_root(distance(a, b), True) if a != b else 0.0 for a, b in zip(exact, before or exact)])

    def assign(self, values: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Move the bounds with the centroids and each row to its nearest centroid, all in place; returns how many
        distances were worked out."""
        rows, k = lower.shape
        upper[:] = np.nextafter(upper + self.moved[at], math.inf)
        lower[:] = np.maximum(0.0, np.nextafter(lower - self.moved, -math.inf))
        near = np.flatnonzero(~(upper < self.half.min(axis=1)[at]))
        if not len(near):
            return 0
        worked, v, own, u, low = 0, values[near], at[near], upper[near], lower[near]
        square = np.zeros(len(near), object if v.dtype == object or self.values.dtype == object else np.int64)
        known = np.zeros(len(near), bool)
        for c in range(k):
            rest = np.flatnonzero((own != c) & ~(u < low[:, c]) & ~(u < self.half[own, c]))
            new = rest[~known[rest]]
            if len(new):
                exact = squared(v[new], self.values[own[new]])
                square = square.astype(exact.dtype) if exact.dtype == object else square
                square[new], known[new], worked = exact, True, worked + len(new)
                u[new], low[new, own[new]] = roots(exact, True), roots(exact, False)
                rest = rest[~(u[rest] < low[rest, c]) & ~(u[rest] < self.half[own[rest], c])]
            if not len(rest):
                continue
            exact = squared(v[rest], np.broadcast_to(self.values[c], v[rest].shape))
            square = square.astype(exact.dtype) if exact.dtype == object else square
            worked += len(rest)
            low[rest, c] = roots(exact, False)
            closer = (exact < square[rest]) | ((exact == square[rest]) & (c < own[rest]))
            moves = rest[closer]
            own[moves], square[moves], u[moves] = c, exact[closer], roots(exact[closer], True)
        at[near], upper[near], lower[near] = own, u, low
        return worked


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _assigned(state: DataFrame, centroids: Centroids, scale: int, last: bool) -> DataFrame:
    """The state after one assignment; of the last one ``(vec_id, cluster, distance)`` with exact distances."""
    k = len(centroids.exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            values = quantised(_matrix(batch.column(1), rows), scale)
            at, upper = batch.column(2).to_numpy().astype(np.int32), np.array(batch.column(3).to_numpy(), np.float64)
            lower = _matrix(batch.column(4), rows)
            worked = centroids.assign(values, at, upper, lower)
            if last:
                exact = [min(d, _MOST) for d in squared(values, centroids.values[at]).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(exact, pa.int64())], ["vec_id", "cluster", "distance"])
            else:
                low = pa.ListArray.from_arrays(np.arange(0, rows * k + 1, k, dtype=np.int32), lower.ravel())
                of = [batch.column(0), batch.column(1), pa.array(at), pa.array(upper), low, pa.array(np.append(np.zeros(rows - 1, np.int64), worked))]
                yield pa.RecordBatch.from_arrays(of, ["vec_id", "v", "cluster", "upper", "lower", "worked"])

    kind = dict(state.dtypes)["v"]
    schema = "vec_id long, cluster int, distance long" if last else f"vec_id long, v {kind}, cluster int, upper double, lower array<double>, worked long"
    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, k: int, scale: int) -> list[tuple[int, list[int]]]:
    """Of each cluster the number of its vectors and their exact sums. A task gives a row for each digit of its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = quantised(_matrix(batch.column(0), batch.num_rows), scale)
            at = batch.column(1).to_numpy()
            sums = [[0] * values.shape[1] for _ in range(k)] if sums is None else sums
            narrow = values.dtype != object and np.abs(values).max(initial=0) < 1 << 40  # then a batch adds up in 64 bits
            counts += np.bincount(at, minlength=k)
            for c in np.unique(at).tolist():
                own = values[at == c] if narrow else values[at == c].astype(object)
                sums[c] = [x + int(y) for x, y in zip(sums[c], own.sum(axis=0).tolist())]
        out = [(c, -1, 0, n) for c, n in enumerate(counts.tolist()) if n]
        for c, d, total in ((c, d, x) for c, xs in enumerate(sums or []) for d, x in enumerate(xs)):
            place = 0
            while total:
                # the sign stays with the digits
                size, digit = divmod(abs(total), 1 << _DIGIT)
                out.append((c, d, place, digit if total > 0 else -digit))
                total, place = (size if total > 0 else -size), place + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], ["cluster", "d", "place", "digit"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster long, d long, place long, digit long")
    width = 0
    found = {}
    for r in parts.groupBy("cluster", "d", "place").agg(F.sum("digit").alias("digit")).collect():
        width = max(width, r["d"] + 1)
        found[r["cluster"], r["d"]] = found.get((r["cluster"], r["d"]), 0) + (r["digit"] << _DIGIT * r["place"])
    return [(found.get((c, -1), 0), [found.get((c, d), 0) for d in range(width)]) for c in range(k)]


def start(rows: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The k rows of ``rows(vec_id, v)`` with the smallest hex SHA-256 of ``seed:vec_id``, in that order; of repeated ids
    the smaller vectors."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first: list[Row] = rows.select("v", name.alias("name")).orderBy("name", "v").limit(k).collect()
    return [[int(x) for x in quantised(np.array([r["v"]], np.float64), scale)[0]] for r in first]


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1", state_of_rounds: list | None = None) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each row of
    ``vectors(vec_id, embedding)`` with ``width`` components, none null or not finite; others take no part, and neither
    do rows with a null id.

    ``rounds`` times every vector goes to its nearest centroid, ties to the smaller number, and every centroid that has
    vectors becomes the floor of their exact mean; then they are assigned once more. Fewer rows than k make fewer
    centroids; equal centroids are allowed, and the larger numbers of those stay empty. Repeated rows count each. Components
    of any size are exact; a distance or a sum that no long holds is returned as the largest long. An empty table
    gives an empty one; further columns, whatever their names, are not read. ``state_of_rounds`` takes the number of
    distances that each round worked out.
    """
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") == width) & fine)
    exact = start(rows, k, scale, seed)
    k = len(exact)
    centroids = Centroids(exact)
    # nothing is known before the first round: no lower bound is over zero, and the upper ones have no end
    unknown = [F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), k).alias("lower"), F.lit(0).cast("long").alias("worked")]
    state, held = rows.select("*", *unknown), []
    for _ in range(rounds if k else 0):
        state = materialise(_assigned(state, centroids, scale, last=False), "bounds")
        discard(*held)
        held = [state]
        if state_of_rounds is not None:
            state_of_rounds.append(state.agg(F.sum("worked")).first()[0])
        moved = [[int(s // n) for s in total] if n else c for c, (n, total) in zip(exact, _sums(state, k, scale))]
        centroids, exact = Centroids(moved, exact), moved
    found = materialise(_assigned(state, centroids, scale, last=True), "clusters")
    discard(*held)
    # a row for each cluster; sums may pass a long
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = min(_MOST, sum(inertia.values()))
    told = [(c, min(_MOST, n), every, hashlib.sha256(",".join(map(str, exact[c])).encode()).hexdigest()) for c, n in inertia.items()]
    told = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, width=64, scale=64, seed="1")
