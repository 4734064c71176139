"""Centroid clustering whose comparisons are filtered by n-simplex projection.

A few pivots, affinely independent, are the base of a simplex. A vector's
distances to them fix the apex of a simplex over that base: its coordinates in
the pivots' hull and its height above it. Of two apexes, the Euclidean
distance is a lower bound of the vectors' distance, and the distance with one
of them mirrored below the hull an upper bound. The vectors' apexes are
computed once and stored next to them; a round computes those of the
centroids alone, drops for each vector every centroid whose lower bound is
above the smallest upper bound, and compares the rest in whole numbers.

The bounds are doubles: each apex carries a bound of its own rounding error,
by which lower bounds are lowered and upper bounds raised, so no centroid that
could be the nearest is dropped.

A round is one pass over the stored vectors. A task returns the sums of its
vectors per centroid; centroids (k times the dimension) are all that meets at
the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import Stored

#: Most pivots, and the least height of a pivot over those before it, as a share of the base's width.
PIVOTS, LEAST_HEIGHT = 16, 0.05
#: Components beyond this count as this: their squared distances would not fit in 64 bits.
LIMIT = 1 << 26
#: Rows compared at a time.
ROWS_AT_ONCE = 4096
_EPS = float(np.finfo(np.float64).eps)
_LONGEST = (1 << 63) - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, whole numbers."""
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


class Simplex:
    """The base simplex of some pivots among ``points`` (rows of whole numbers, at least one)."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        far = np.sqrt(squared(points, points[:1]).max())
        self.pivots = points[:1]
        self.base = np.zeros((0, 0))  # row j: coordinates of pivot j + 1, lower triangular; pivot 0 is the origin
        while len(self.pivots) < most:
            apex, _ = self.project(points)
            top = int(apex[:, -1].argmax())
            if apex[top, -1] <= LEAST_HEIGHT * far or far == 0:
                break
            n = len(self.base)
            grown = np.zeros((n + 1, n + 1))
            grown[:n, :n] = self.base
            grown[n] = apex[top]
            self.base, self.pivots = grown, np.r_[self.pivots, points[top:top + 1]]

    def project(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apexes of ``rows`` (coordinates in the hull, then the height) and bounds of their rounding errors."""
        d2 = squared(rows, self.pivots).astype(np.float64)
        n = len(self.base)
        if not n:
            return np.sqrt(d2), 4 * _EPS * np.sqrt(d2[:, 0])
        norms = (self.base ** 2).sum(axis=1)
        right = d2[:, :1] - d2[:, 1:] + norms
        inverse = np.linalg.inv(2 * self.base)
        y = right @ inverse.T
        size = d2[:, :1] + d2[:, 1:] + norms
        error = 64 * (n + 1) * _EPS * (size @ np.abs(inverse).T + np.abs(y) @ (np.abs(2 * self.base).T @ np.abs(inverse).T))
        height2 = d2[:, 0] - (y * y).sum(axis=1)
        wrong = 2 * (np.abs(y) * error).sum(axis=1) + (error * error).sum(axis=1) + 8 * (n + 1) * _EPS * d2[:, 0]
        height = np.sqrt(np.maximum(height2, 0))
        off = np.minimum(np.sqrt(wrong), wrong / np.maximum(height, 1e-300)) + np.sqrt(np.maximum(-height2, 0))
        return np.c_[y, height], np.sqrt((error * error).sum(axis=1)) + 2 * off


def bounds(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all vectors with apexes ``a`` to all with apexes ``b``."""
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    off = (a_off[:, None] + b_off[None, :]) * (1 + 1e-9) + 1e-9
    low = np.sqrt(flat + (a[:, None, -1] - b[None, :, -1]) ** 2)
    high = np.sqrt(flat + (a[:, None, -1] + b[None, :, -1]) ** 2)
    return low * (1 - 1e-9) - off, high * (1 + 1e-9) + off


def nearest(rows: np.ndarray, apex: np.ndarray, off: np.ndarray, centroids: np.ndarray, c_apex: np.ndarray,
            c_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many exact comparisons that took."""
    low, high = bounds(apex, off, c_apex, c_off)
    row, c = np.nonzero(low <= high.min(axis=1)[:, None])
    gap = rows[row] - centroids[c]
    d2 = np.full(low.shape, _LONGEST, dtype=np.int64)
    d2[row, c] = (gap * gap).sum(axis=1)
    best = d2.argmin(axis=1)
    return best, d2[np.arange(len(rows)), best], len(row)


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, ROWS_AT_ONCE):
        yield b.slice(at, ROWS_AT_ONCE)


def kept_vectors(df: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors of ``dim`` components, none null or non-finite."""
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
            .filter(F.coalesce((F.size("e") == dim) & good, F.lit(False))).select("vec_id", whole.alias("v")))


class _Assigner:
    """A round's centroids with their apexes, as sent to the tasks."""

    def __init__(self, simplex: Simplex, centroids: np.ndarray):
        self.centroids = centroids
        self.apex, self.off = simplex.project(centroids)

    def __call__(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = _vectors(b, self.centroids.shape[1])
        apex = b.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        best, d2, _ = nearest(rows, apex, b.column("off").to_numpy(), self.centroids, self.apex, self.off)
        return rows, best, d2


def _projected(rows: DataFrame, simplex: Simplex, dim: int) -> DataFrame:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apex, off = simplex.project(_vectors(b, dim))
            apexes = pa.ListArray.from_arrays(pa.array(np.arange(0, apex.size + 1, apex.shape[1]), pa.int32()), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), apexes, pa.array(off)], ["vec_id", "v", "apex", "off"])

    return rows.mapInArrow(project, "vec_id long, v array<int>, apex array<double>, off double")


def _next_centroids(stored: DataFrame, assign: _Assigner) -> np.ndarray:
    """Componentwise floor(sum / count) of each centroid's vectors; those without vectors stay."""
    k, dim = assign.centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for whole in batches:
            for b in _slices(whole):
                rows, best, _ = assign(b)
                n += np.bincount(best, minlength=k)
                order = best.argsort(kind="stable")
                which, first = np.unique(best[order], return_index=True)
                total[which] += np.add.reduceat(rows[order], first, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])

    parts = stored.mapInArrow(sums, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("pos", "x"))
    found = parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # at most k x dim rows
    out = assign.centroids.copy()
    for r in found:
        out[r.cluster, r.pos] = r.x // r.n
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Those are the vectors of exactly ``dim`` components, none null or
    non-finite, as floor(``scale`` * component); components beyond ``LIMIT``
    count as ``LIMIT``. Centroids start as the ``k`` of smallest SHA-256 of
    ``seed:id`` (equal ids: by their components; null ids last; fewer vectors:
    all of them). Each round moves every centroid to the floor of its vectors'
    mean; then vectors are assigned once more. ``distance`` is squared,
    inertias beyond 64 bits are the largest long. Repeated rows count and come
    back repeatedly, a null id stays null; other columns are not read. A table
    without such vectors gives an empty result.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, dim, scale, id_col, vec_col)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.withColumn("h", drawn).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], dtype=np.int64)
    simplex = Simplex(centroids)
    stored = Stored(_projected(rows, simplex, dim), "apexes")
    for _ in range(rounds):
        centroids = _next_centroids(stored.df, _Assigner(simplex, centroids))
    last = _Assigner(simplex, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                _, best, d2 = last(b)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(d2)], ["vec_id", "cluster", "distance"])

    out = Stored(stored.df.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters")
    stored.drop()
    per = {r.cluster: int(r.s) for r in out.df.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    notes = [(c, min(s, _LONGEST), min(sum(per.values()), _LONGEST), shas[c]) for c, s in per.items()]  # at most k rows
    noted = F.broadcast(spark.createDataFrame(notes, "c int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return out.df.join(noted, F.col("cluster") == F.col("c")).drop("c")
