"""Centroid clustering: integer k-means in which segment norms screen the centroids that need a distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut

#: Components up to this size have squares, sums and bounds of 64 bits; wider vectors are compared in Python's integers.
NARROW = 1 << 26
_LARGEST = (1 << 63) - 1


def segment_edges(dim: int, segments: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int))


def compress(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's squared norm and its segments' norms, rounded up to integers.

    A product of two segments is at most that of their norms (Cauchy-Schwarz), and rounding up keeps that, so
    |x|^2 + |y|^2 - 2 * sum of the norms' products is never over the squared distance. Of wide rows the square is so low that nothing is screened.
    """
    wide = (np.abs(x) > NARROW).any(axis=1)
    narrow = np.where(wide[:, None], 0, x)
    squares = np.add.reduceat(narrow * narrow, segment_edges(x.shape[1], segments)[:-1], axis=1)
    norms = np.ceil(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    norms += norms * norms < squares  # a root may be rounded down beyond 2^53
    return np.where(wide, -(1 << 61), squares.sum(axis=1)), norms


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; beyond 64 bits they are Python's integers."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) > NARROW:
        x, y = x.astype(object), y.astype(object)
    step = x - y
    return (step * step).sum(axis=1)


def assign(x: np.ndarray, square: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, distance, distances computed): the nearest centroid of each row, of equally near ones the first.

    The centroid of the smallest bound is measured first; the others only for rows whose bound is not over the best distance so far.
    """
    c_square, c_norms = compress(centroids, norms.shape[1])
    bound = square[:, None] + c_square[None, :] - 2 * (norms @ c_norms.T)
    cluster = bound.argmin(axis=1)
    best, computed, first = distances(x, centroids[cluster]), len(x), cluster.copy()
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= best) & (first != k))
        if not len(rows):
            continue
        computed += len(rows)
        d = distances(x[rows], centroids[k][None, :])
        if d.dtype == object and best.dtype != object:
            best = best.astype(object)
        nearer = (d < best[rows]) | ((d == best[rows]) & (k < cluster[rows]))
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], k
    return cluster, best, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, vec array<long>): floor(scale * x) of the vectors with exactly dim components, none null or non-finite.

    A vector with a scaled component of 2^62 or more has no 64-bit integers and is left out too.
    """
    x = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float(1 << 62)))
    return rows.where((F.size(x) == dim) & whole).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("vec"))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, dim: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3, segments: int = 16) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector kept by integer_vectors().

    Centroids start as the k vectors of smallest sha256 of `<seed>:<vec_id>` (a null id is empty text; equal ids go by their
    vectors; fewer vectors, fewer centroids). Each round replaces every centroid that has vectors by their floor(sum / count).
    Vectors and their segment norms are written once; a round scans them, and each task hands on one row of sums a
    cluster, so k rows of dim sums reach the driver whatever the number of vectors. Sums beyond 64 bits are exact;
    returned distances and inertias stop at 2^63 - 1. Repeated rows count each; no rows give no rows; other columns are not read.
    """

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            square, norms = compress(_matrix(batch.column("vec"), dim), segments)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, norms.size + 1, norms.shape[1], dtype=np.int32)), pa.array(norms.ravel()))
            yield pa.record_batch([batch.column("vec_id"), batch.column("vec"), pa.array(square), flat], ["vec_id", "vec", "square", "norms"])

    width = len(segment_edges(dim, segments)) - 1
    kept = integer_vectors(vectors, id_col, vec_col, dim, scale)
    table = cut(kept.mapInArrow(compressed, "vec_id long, vec array<long>, square long, norms array<long>"), "vectors")
    start = table.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "vec").limit(k)
    centroids = np.array([r["vec"] for r in start.select("vec").collect()], np.int64).reshape(-1, dim)

    def nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(batch.column("vec"), dim)
        return x, *assign(x, np.asarray(batch.column("square")), _matrix(batch.column("norms"), width), centroids)[:2]

    def sums_by(centroids: np.ndarray) -> list:
        """Of each cluster that has vectors: their number, summed distance, and sums by component."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, inertia, total = [0] * len(centroids), [0] * len(centroids), np.zeros(centroids.shape, object)
            for batch in batches:
                x, cluster, distance = nearest(batch, centroids)
                wide = np.abs(x).max(initial=0) > NARROW
                for c in np.unique(cluster):
                    of = cluster == c
                    n[c] += int(of.sum())
                    inertia[c] += int(distance[of].astype(object).sum())
                    total[c] += (x[of].astype(object) if wide else x[of]).sum(axis=0)
            some = [c for c in range(len(n)) if n[c]]
            exact = pa.decimal128(38, 0)
            yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": pa.array([n[c] for c in some], pa.int64()), "inertia": pa.array([Decimal(inertia[c]) for c in some], exact), "total": pa.array([[Decimal(int(v)) for v in total[c]] for c in some], pa.list_(exact))})

        parts = table.mapInArrow(run, "cluster int, n long, inertia decimal(38,0), total array<decimal(38,0)>")
        return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)]).collect()

    for _ in range(rounds if len(centroids) else 0):
        for row in sums_by(centroids):
            centroids[row["cluster"]] = [int(row[f"t{i}"]) // row["n"] for i in range(dim)]
    inertias = {r["cluster"]: int(r["inertia"]) for r in sums_by(centroids)} if len(centroids) else {}
    final = centroids

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = nearest(batch, final)
            yield pa.record_batch([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(np.minimum(distance, _LARGEST).astype(np.int64))], ["vec_id", "cluster", "distance"])

    of_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return table.mapInArrow(label, "vec_id long, cluster int, distance long").select(
        "vec_id", "cluster", "distance",
        of_cluster([min(inertias.get(c, 0), _LARGEST) for c in range(len(final))], "long").alias("cluster_inertia"),
        F.lit(min(sum(inertias.values()), _LARGEST)).cast("long").alias("inertia"),
        of_cluster([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in final], "string").alias("centroid_sha256"),
    )
