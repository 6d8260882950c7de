"""Exact centroid clustering of integer vectors by annulus search.

Centroids are sorted by norm. A vector's distance to the centroid of nearest norm bounds its distance to the nearest
centroid, and by the triangle inequality only centroids whose norm differs from the vector's by at most that bound can be
as near: two binary searches give this annulus, and the candidates in it, ties on its border included, are compared exactly
in integers. Each round is one scan: a task keeps one integer sum for each cluster and component, an aggregate adds the
tasks' sums exactly, and the driver gets clusters x components numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, materialize

#: Greatest magnitude of an integer component: squared distances of 64 of them fit a long, and so do dot products.
MOST = 1 << 27
#: Widening of an annulus by which rounded square roots lose no candidate.
SLACK = 1e-6


class Annulus:
    """Centroids (integer rows) in order of their norms; finds the nearest of each vector, the smaller number at a tie."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.squares = (centroids * centroids).sum(1)
        self.order = np.argsort(self.squares, kind="stable")
        self.norms = np.sqrt(self.squares[self.order].astype(np.float64))

    def candidates(self, squares: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where in the order of norms the centroids lie that may be as near as the squared distance first."""
        norm, reach = np.sqrt(squares.astype(np.float64)), np.sqrt(first.astype(np.float64))
        slack = SLACK * (1 + norm + reach)
        return np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")

    def _distance(self, vectors: np.ndarray, squares: np.ndarray, number) -> np.ndarray:
        own = self.centroids[number]
        dots = vectors @ own if own.ndim == 1 else np.einsum("ij,ij->i", vectors, own)
        return squares - 2 * dots + self.squares[number]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid and the squared distance to it."""
        squares = (vectors * vectors).sum(1)
        norm = np.sqrt(squares.astype(np.float64))
        right = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        guess = np.where(np.abs(self.norms[left] - norm) < np.abs(self.norms[right] - norm), left, right)
        best = self.order[guess]
        least = self._distance(vectors, squares, best)
        low, high = self.candidates(squares, least)
        for place, number in enumerate(self.order.tolist()):
            rows = np.flatnonzero((low <= place) & (place < high) & (guess != place))
            if len(rows):
                found = self._distance(vectors[rows], squares[rows], number)
                nearer = (found < least[rows]) | (found == least[rows]) & (number < best[rows])
                best[rows[nearer]], least[rows[nearer]] = number, found[nearer]
        return best, least


def _integers(column: pa.Array, scale: int, dims: int) -> np.ndarray:
    """Rows of floor(scale * component) of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    out = np.floor(scale * values)
    if len(out) and np.abs(out).max() > MOST:
        raise OverflowError(f"a component times {scale} is beyond {MOST}: squared distances would not fit a long")
    return out.astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], held, scale: int, dims: int) -> Iterator[pa.RecordBatch]:
    """The task's number of vectors and componentwise sum for each cluster that it met."""
    find = Annulus(held.value)
    count, total = np.zeros(len(held.value), np.int64), np.zeros(held.value.shape, np.int64)
    for batch in batches:
        vectors = _integers(batch.column("v"), scale, dims)
        if len(vectors):
            best, _ = find.nearest(vectors)
            count += np.bincount(best, minlength=len(count))
            np.add.at(total, best, vectors)
    met = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], held, scale: int, dims: int) -> Iterator[pa.RecordBatch]:
    find = Annulus(held.value)
    for batch in batches:
        vectors = _integers(batch.column("v"), scale, dims)
        best, least = find.nearest(vectors) if len(vectors) else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v) of the rows of vectors (vec_id, embedding) with exactly dims components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def centroids_of(vectors: DataFrame, *, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> np.ndarray:
    """The centroids after the rounds, k rows or one for each of fewer vectors; of kept vectors (vec_id, v)."""
    spark = vectors.sparkSession
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").orderBy(hashed, "v").limit(k).select("v").toArrow()
    now = _integers(first["v"].combine_chunks(), scale, dims) if first.num_rows else np.zeros((0, dims), np.int64)
    for _ in range(rounds if len(now) else 0):
        held = spark.sparkContext.broadcast(now)
        parts = in_arrow(vectors.select("v"), lambda b, held=held: _sums(b, held, scale, dims), "cluster int, n long, sums array<long>")
        wide = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at")
        rows = wide.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        now = now.copy()
        for row in rows:  # k times dims of them; floor division of whole numbers is exact
            now[row["cluster"], row["at"]] = int(row["s"]) // int(row["n"])
        held.unpersist()
    return now


def centroid_clusters(vectors: DataFrame, *, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row of vectors (vec_id, embedding;
    other columns are ignored).

    Kept are vectors of exactly dims components, none null or non-finite; a component x counts as floor(scale * x). The k
    first by sha256 of '<seed>:<vec_id>' are the first centroids (repeated ids: the smaller vector first); rounds of exact
    assignment and exact floored means follow. Distances are squared; at a tie the smaller number wins, so of equal
    centroids the later ones are empty and stay. Rows without an id are clustered but are no first centroids. Repeated rows
    count each time. With fewer than k vectors there are as many centroids; an empty table gives no rows. Integer components
    beyond 2**27 raise an error, since their distances don't fit a long.
    """
    kept = kept_vectors(vectors, dims)
    final = centroids_of(kept, k=k, rounds=rounds, scale=scale, dims=dims, seed=seed)
    spark = vectors.sparkSession
    if not len(final):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    held = spark.sparkContext.broadcast(final)
    rows = materialize(in_arrow(kept, lambda b: _assigned(b, held, scale, dims), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    by = spark.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), name) for c, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
