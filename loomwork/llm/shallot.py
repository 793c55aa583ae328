"""Centroid clustering of integer vectors: exact k-means rounds with Shallot's bounds.

Components become integers, floor(64 * x) of the double x, and all distances that decide anything are squared Euclidean
distances of integers, so ties (to the smaller centroid) and results are exact and the same for any partitioning.

Between rounds each vector keeps its centroid, the second-nearest centroid it knew, an upper bound of the distance to the
first and a lower bound of that to all others. A round moves the bounds by how far centroids went; vectors whose bounds still
tell the two apart are not touched. The others start from the closer of the two remembered centroids and walk along that
one's list of neighbours, sorted by distance: a centroid nearer to the vector than the second-best one found so far lies within
(distance to the start + distance to the second) of the start, so the walk ends at the first neighbour outside that ball, which
shrinks whenever something nearer is found.

Rules: vectors count as kept with exactly `size` components, none null or non-finite; equal rows and repeated vec_ids each take
part; vectors with a null vec_id are seeds only after all others; with fewer vectors than k there are as many centroids as
vectors; no vector gives no rows. Columns besides vec_id and embedding are not read. A distance or inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import drop_table, materialize

#: Components are integers of this many to the unit.
SCALE = 64
#: Sums travel as numbers of this many bits with a place each, so that they never leave a long.
LIMB = 40
#: Integers up to this are squared and summed over a vector within a long; vectors beyond are compared as unbounded integers.
SMALL = 1 << 27
#: Rounding of the double bounds, many times what it can be.
SLACK = 1e-9
STATE = "vec_id long, embedding array<double>, cluster int, second int, upper double, lower double, distance long, looked long"


def whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite double."""
    return int(x) * SCALE if abs(x) >= 2.0**60 else int(np.floor(SCALE * x))


@dataclass
class Centroids:
    """Centroids of one round, with what a walk needs to know of them; moved: how far each went since the round before."""

    rows: list[list[int]]
    moved: np.ndarray | None = None
    order: np.ndarray = field(init=False)
    apart: np.ndarray = field(init=False)
    half: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        k = len(self.rows)
        full = np.array([[float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 for y in self.rows] for x in self.rows])
        np.fill_diagonal(full, -1)
        self.order = np.argsort(full, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(full, self.order, axis=1)
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)

    @property
    def small(self) -> bool:
        return all(abs(a) <= SMALL for row in self.rows for a in row)


def shifts(before: list[list[int]], after: list[list[int]]) -> np.ndarray:
    return np.array([float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 for x, y in zip(before, after, strict=True)]) * (1 + SLACK)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, row by row or to one row."""
    d = x - c
    return (d * d).sum(axis=1)


class Walk:
    """The assignment of one batch of vectors x (integers, n by size) to centroids."""

    def __init__(self, x: np.ndarray, at: Centroids) -> None:
        self.x, self.at, n = x, at, len(x)
        self.c = np.array(at.rows, dtype=x.dtype)
        self.looked = np.zeros(n, np.int64)
        self.first = np.zeros(n, np.int64)
        self.second = np.full(n, -1)
        self.d1 = np.zeros(n, x.dtype)
        self.d2 = np.zeros(n, x.dtype)

    def _measure(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.looked[rows] += 1
        return distances(self.x[rows], self.c[to])

    def _take(self, rows: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Centroid j, at squared distance d, takes the first or second place of those rows where it belongs there."""
        one = (d < self.d1[rows]) | ((d == self.d1[rows]) & (j < self.first[rows]))
        r = rows[one]
        self.second[r], self.d2[r] = self.first[r], self.d1[r]
        self.first[r], self.d1[r] = j[one], d[one]
        two = ~one & ((self.second[rows] < 0) | (d < self.d2[rows]) | ((d == self.d2[rows]) & (j < self.second[rows])))
        r = rows[two]
        self.second[r], self.d2[r] = j[two], d[two]

    def scan(self) -> None:
        """Every centroid, for vectors that nothing is known of."""
        rows = np.arange(len(self.x))
        self.d1 = self._measure(rows, np.zeros(len(rows), np.int64))
        for j in range(1, len(self.c)):
            to = np.full(len(rows), j)
            self._take(rows, to, self._measure(rows, to))

    def search(self, rows: np.ndarray, second: np.ndarray) -> None:
        """Rows whose first is measured already: the remembered second, then the neighbours of the closer of both within the ball."""
        second = np.where(second < 0, self.at.order[self.first[rows], 0], second)
        self._take(rows, second, self._measure(rows, second))
        start = self.first[rows].copy()
        reach, known = np.sqrt(self.d1[rows].astype(float)), self.second[rows].copy()
        for t in range(self.at.order.shape[1]):
            ball = (reach + np.sqrt(self.d2[rows].astype(float))) * (1 + SLACK)
            live = self.at.apart[start, t] <= ball
            rows, start, reach, known = rows[live], start[live], reach[live], known[live]
            if not len(rows):
                break
            j = self.at.order[start, t]
            new = j != known
            self._take(rows[new], j[new], self._measure(rows[new], j[new]))


def assign(x: np.ndarray, at: Centroids, first: np.ndarray | None = None, second: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
    """(first, second, upper, lower, squared distance or -1 where the bounds were enough, distances taken) of each row of x."""
    walk, n = Walk(x, at), len(x)
    if first is None:
        walk.scan()
        done = np.ones(n, bool)
        upper = lower = np.zeros(n)
    else:
        walk.first, walk.second = first.astype(np.int64), second.astype(np.int64)
        if len(at.rows) == 1:
            return first, second, upper, lower, np.full(n, -1, x.dtype), walk.looked
        ranked = np.sort(at.moved)
        other = np.where(at.moved[walk.first] == ranked[-1], ranked[-2], ranked[-1])  # the farthest move of the other centroids
        upper = (upper + at.moved[walk.first]) * (1 + SLACK)
        lower = np.maximum(0, lower * (1 - SLACK) - other)
        safe = np.maximum(lower, at.half[walk.first]) * (1 - SLACK)
        rows = np.flatnonzero(~(upper < safe))
        walk.d1[rows] = walk._measure(rows, walk.first[rows])
        upper[rows] = np.sqrt(walk.d1[rows].astype(float)) * (1 + SLACK)
        rows = rows[~(upper[rows] < safe[rows])]
        remembered = walk.second[rows].copy()
        walk.second[rows] = -1
        walk.search(rows, remembered)
        done = np.zeros(n, bool)
        done[rows] = True
    upper = np.where(done, np.sqrt(walk.d1.astype(float)) * (1 + SLACK), upper)
    lower = np.where(done, np.where(walk.second < 0, np.inf, np.sqrt(walk.d2.astype(float)) * (1 - SLACK)), lower)
    return walk.first, walk.second, upper, lower, np.where(done, walk.d1, -1), walk.looked


def _groups(values: np.ndarray, at: Centroids | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integers): those within SMALL as longs, others, or all where a centroid is larger, as unbounded integers."""
    fits = (np.abs(values) < SMALL / SCALE).all(axis=1) & (at is None or at.small)
    rows = np.flatnonzero(fits)
    if len(rows):
        yield rows, np.floor(values[rows] * SCALE).astype(np.int64)
    rows = np.flatnonzero(~fits)
    if len(rows):
        yield rows, np.array([[whole(v) for v in row] for row in values[rows]], dtype=object)


def _values(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _longs(values: list[int]) -> pa.Array:
    return pa.array([v if v < 1 << 63 else None for v in values], pa.int64())


def _assigned(state: DataFrame, at: Centroids, size: int, known: bool, last: bool) -> DataFrame:
    """state after one assignment; the last one measures every vector's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = _values(batch, size)
            cluster, second, upper, lower, looked = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            exact: list[int] = [-1] * n
            old = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "second", "upper", "lower", "looked")} if known else {}
            for rows, x in _groups(values, at):
                before = [old[c][rows] for c in ("cluster", "second", "upper", "lower")] if known else []
                first, other, up, low, d, more = assign(x, at, *before)
                if last and (open_ := np.flatnonzero(d < 0)).size:
                    d[open_] = distances(x[open_], np.array(at.rows, dtype=x.dtype)[first[open_]])
                cluster[rows], second[rows], upper[rows], lower[rows], looked[rows] = first, other, up, low, more
                for i, v in zip(rows.tolist(), d.tolist(), strict=True):
                    exact[i] = v
            looked = looked + old["looked"] if known else looked
            columns = [batch.column("vec_id"), pa.array(values.reshape(-1)), *(pa.array(a) for a in (cluster, second, upper, lower)), _longs(exact), pa.array(looked)]
            columns[1] = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, size, dtype=np.int32)), columns[1])
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "cluster", "second", "upper", "lower", "distance", "looked"])

    return state.mapInArrow(run, STATE)


def _totals(state: DataFrame, k: int, size: int) -> tuple[list[int], list[list[int]]]:
    """Vectors and exact componentwise sums of each cluster: partial sums by task, then at most k * size numbers of few limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, [[0] * size for _ in range(k)]
        for batch in batches:
            values, cluster = _values(batch, size), batch.column("cluster").to_numpy(zero_copy_only=False)
            for rows, x in _groups(values, None):
                for j in np.unique(cluster[rows]).tolist():
                    mine = x[cluster[rows] == j]
                    count[j] += len(mine)
                    total[j] = [a + b for a, b in zip(total[j], mine.sum(axis=0).tolist(), strict=True)]
        found: list[tuple[int, int, int, int]] = []
        for j in (j for j in range(k) if count[j]):
            found.append((j, -1, 0, count[j]))
            for i, v in enumerate(total[j]):
                place = 0
                while place == 0 or v not in (0, -1):
                    found.append((j, i, place, v & ((1 << LIMB) - 1)))
                    v, place = v >> LIMB, place + 1
                found.append((j, i, place, v))  # what is left is the sign, 0 or -1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "part", "place", "value"])

    parts = state.select("cluster", "embedding").mapInArrow(run, "cluster int, part int, place int, value long")
    count, total = [0] * k, [[0] * size for _ in range(k)]
    for r in parts.groupBy("cluster", "part", "place").agg(F.sum("value").alias("value")).collect():
        if r["part"] < 0:
            count[r["cluster"]] = r["value"]
        else:
            total[r["cluster"]][r["part"]] += r["value"] << (LIMB * r["place"])
    return count, total


def kept(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    limit = float("inf")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == size) & ~F.exists("embedding", odd))


def seeds(rows: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of salt:vec_id, ties to the smaller components; null ids come last."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    best = rows.select(mark.alias("mark"), "embedding").orderBy(F.asc_nulls_last("mark"), "embedding").limit(k).collect()
    return [[whole(v) for v in r["embedding"]] for r in best]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, salt: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and looked (integer distances taken) of each kept vector.

    `rounds` times every vector goes to its nearest centroid and every centroid that has vectors becomes floor(sum / count)
    of theirs; then vectors are assigned once more. The state is written to the shared folder in each round; only the k
    centroids, k * size numbers, pass through the driver and to all tasks.
    """
    spark, rows = vectors.sparkSession, kept(vectors, size)
    centroids = seeds(rows, k, salt)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, looked long")
    at, state, known = Centroids(centroids), rows, False
    for _ in range(rounds):
        after = materialize(_assigned(state, at, size, known, False), "clusters")
        if known:
            drop_table(state)
        count, total = _totals(after, len(centroids), size)
        moved = [[s // n for s in total[j]] if (n := count[j]) else centroids[j] for j in range(len(centroids))]
        at, centroids, state, known = Centroids(moved, shifts(centroids, moved)), moved, after, True
    done = materialize(_assigned(state, at, size, known, True), "clusters")
    if known:
        drop_table(state)
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"), F.bool_or(F.col("distance").isNull()).alias("beyond")).collect()  # k rows
    own = {r["cluster"]: None if r["beyond"] else int(r["own"]) for r in sums}
    inertia = None if None in own.values() else sum(own.values())
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    marks = [(j, fits(v), fits(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, v in own.items()]
    table = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "looked")
