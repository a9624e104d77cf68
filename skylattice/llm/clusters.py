"""Centroid clustering of vectors by annulus search.

Vectors are made of integers, so distances, sums and means are exact and don't depend on the order of rows.
Centroids are sorted by their norm. For a vector of norm r, the centroid of the nearest norm and that at the
middle of the sorted norms give an upper bound u of the least distance, and only centroids with a norm in
[r - u, r + u] can be as near as that; binary search finds them, both ends included, and their distances are compared
exactly, so that of centroids equally near the smallest number wins. Each round every task keeps sums of
its own vectors by centroid, at most K x DIM numbers; Spark adds them by centroid and component, and the driver
gets the sums of the K centroids only, however many vectors there are.

Nulls and other cases: null vectors, vectors of another length and those with null, NaN or infinite components
are left out; a null vec_id is hashed as an empty id, takes part and is returned as null; rows of one
vec_id are vectors each, and start in the order of their components; with fewer vectors than K there are as many centroids as vectors; an empty table
gives an empty result. Components whose integers are beyond LARGEST raise an error, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import slices, stored

#: Components of a vector, what they are multiplied with, centroids, rounds, and the seed of the first centroids.
DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: The largest integer of a component: squared distances of 64 components stay below 2 ** 63.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the integers floor(scale * x), of the vectors of dim finite components."""
    v = F.col("embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: F.coalesce(odd(x), F.lit(True))), F.lit(False))
    scaled = F.when(whole, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))
    fits = F.array_max("q").between(-LARGEST, LARGEST) & F.array_min("q").between(-LARGEST, LARGEST)
    kept = vectors.select("vec_id", scaled.alias("q")).where("q is not null")
    return kept.where(F.assert_true(F.coalesce(fits, F.lit(True)), "a component is too large").isNull())


def first_centroids(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and its squared distance, of every row of q."""
    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    ring = norms[order]
    own = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    square = lambda rows, number: ((q[rows] - centroids[number]) ** 2).sum(1)
    at = np.clip(np.searchsorted(ring, own), 0, len(ring) - 1)
    at -= (at > 0) & (own - ring[np.maximum(at - 1, 0)] < ring[at] - own)
    best = order[at]
    distance = square(slice(None), best)
    middle = int(order[len(order) // 2])
    other = square(slice(None), middle)
    closer = (other < distance) | ((other == distance) & (middle < best))
    best, distance = np.where(closer, middle, best), np.where(closer, other, distance)
    reach = np.sqrt(distance.astype(np.float64)) * (1 + 1e-12) + 1e-6  # roots are rounded: the annulus is a little wider, never narrower
    low, high = np.searchsorted(ring, own - reach, "left"), np.searchsorted(ring, own + reach, "right")
    for k, number in enumerate(order.tolist()):
        rows = np.flatnonzero((low <= k) & (k < high))
        d = square(rows, number)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (number < best[rows]))
        rows, d = rows[closer], d[closer]
        best[rows], distance[rows] = number, d
    return best.astype(np.int64), distance


def _rows(column, dim: int) -> np.ndarray:
    """The lists of an Arrow column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid replaced by the floor of the mean of the vectors that it is nearest to; those without any stay."""
    k, dim = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in slices(batches, 4096):
            if b.num_rows:
                q = _rows(b.column(0), dim)
                best, _ = nearest(q, centroids)
                order = np.argsort(best, kind="stable")
                there, start = np.unique(best[order], return_index=True)
                sums[there] += np.add.reduceat(q[order], start)
                counts += np.bincount(best, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.record_batch({"cluster": pa.array(own, pa.int32()), "n": pa.array(counts[own]), "sums": pa.array(sums[own].tolist(), pa.list_(pa.int64()))})

    parts = points.select("q").mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster, r["at"]] = r.x // r.n
    return out


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""

    def run(batches):
        for b in slices(batches, 4096):
            if b.num_rows:
                best, distance = nearest(_rows(b.column(1), centroids.shape[1]), centroids)
                yield pa.record_batch({"vec_id": b.column(0), "cluster": pa.array(best, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return points.select(F.col("vec_id").cast("long").alias("vec_id"), "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def fitted(points: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after so many rounds; none for an empty table."""
    centroids = first_centroids(points, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(points, centroids)
    return centroids


def _by_cluster(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    points = quantised(vectors)
    centroids = fitted(points, k, rounds, seed)
    if not len(centroids):
        return points.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")
        )  # no row
    rows = stored(assigned(points, centroids), "clusters-assigned")
    found = {r.cluster: r.x for r in rows.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    inertia = F.element_at(F.array(*[F.lit(found.get(i, 0)).cast("long") for i in range(len(centroids))]), F.col("cluster") + 1)
    sha = _by_cluster([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    return rows.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(found.values())).cast("long").alias("inertia"), sha.alias("centroid_sha256"))
