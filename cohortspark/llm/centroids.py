"""Centroid clustering: the nearest centroid by the threshold algorithm over lists sorted by dimension, exact in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import removed, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components count as at most so much in size, so that squared distances fit a long.
LARGEST = 2**27
#: Vectors walked together, and components converted together.
BLOCK = 4096


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and x, the integers floor(64 * component) as double, of vectors with `dimensions` finite components.

    Others (null, of another length, with a null, NaN or infinite component) are left out. An integer beyond
    +-2**27 counts as +-2**27.
    """
    e = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("e"))
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(SCALE)), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return e.where((F.size("e") == dimensions) & good).select("vec_id", whole.alias("x"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The vectors of the least sha256 of `1:<vec_id>`, in that order; a null vec_id comes last, ties go by components."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("k"), "x").orderBy(F.col("k").asc_nulls_last(), "x").limit(count).collect()
    return np.array([r["x"] for r in rows], np.int64)


class Lists:
    """For each dimension the centroids' values in order, with the centroid of each."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of x and its squared distance; of equally near ones the smaller number.

        All rows walk together. At each step every dimension gives the centroid whose value is next nearest to the
        row's own; centroids met for the first time are measured exactly. A row stops once the sum of its
        frontiers' squared distances is strictly beyond its best, as no centroid unseen can then be as near.
        """
        (k, dims), n = self.centroids.shape, len(x)
        left = np.stack([np.searchsorted(self.values[:, j], x[:, j]) for j in range(dims)], axis=1) - 1
        right = left + 1
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
        seen = np.zeros((n, k), bool)
        rows, column = np.arange(n), np.arange(dims)
        far = np.int64(2**61)
        for _ in range(k):
            y, lo, hi = x[rows], left[rows], right[rows]
            down = np.where(lo >= 0, y - self.values[np.maximum(lo, 0), column], far)
            up = np.where(hi < k, self.values[np.minimum(hi, k - 1), column] - y, far)
            below = down <= up
            met = np.zeros((len(rows), k), bool)
            met[np.arange(len(rows))[:, None], self.order[np.where(below, np.maximum(lo, 0), np.minimum(hi, k - 1)), column]] = True
            met &= ~seen[rows]
            seen[rows] |= met
            left[rows], right[rows] = lo - below, hi + ~below
            for c in np.flatnonzero(met.any(axis=0)):
                here = np.flatnonzero(met[:, c])
                diff = y[here] - self.centroids[c]
                distance = np.einsum("ij,ij->i", diff, diff)
                who = rows[here]
                better = (distance < best[who]) | ((distance == best[who]) & (c < at[who]))
                best[who[better]], at[who[better]] = distance[better], c
            frontier = np.where(below, down, up)
            beyond = np.einsum("ij,ij->i", frontier, frontier) > best[rows]
            rows = rows[~beyond & ~seen[rows].all(axis=1)]
            if not len(rows):
                break
        return at, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            x = part.column(1)
            flat = x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[len(x)].as_py()]
            yield part.column(0), flat.astype(np.int64).reshape(-1, dims)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of each integer vector. The centroids, 8 KB, go with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for ids, x in _blocks(batches, centroids.shape[1]):
            at, best = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """For each cluster and dimension: the exact sum of its vectors' components and how many there are; 1,024 rows at most a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        lists, sums, counts = Lists(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, dims):
            at = lists.nearest(x)[0]
            np.add.at(counts, at, 1)
            for c in np.unique(at):
                sums[c] += x[at == c].sum(axis=0)
        some = np.flatnonzero(counts)
        cluster, dim = np.repeat(some, dims), np.tile(np.arange(dims), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], dims))], names=["cluster", "dim", "total", "n"])

    parts = vectors.mapInArrow(run, "cluster int, dim int, total long, n long")
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the exact floor of its vectors' mean; an empty one stays."""
    out = centroids.copy()
    for r in cluster_sums(vectors, centroids).collect():
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def centroid_clusters(embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every vector kept.

    Repeated rows are vectors of their own. With fewer vectors than `count` there are fewer centroids; with none
    the result is empty. Columns other than vec_id and embedding play no part. Each round is one pass over the
    vectors; only sums come to the driver (at most count * dimensions rows).
    """
    spark = embeddings.sparkSession
    vectors = written(integer_vectors(embeddings, dimensions), "vectors")
    centroids = first_centroids(vectors, count)
    if not len(centroids):
        removed(vectors)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = written(assigned(vectors, centroids), "clusters")
    removed(vectors)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist()) for c, s in sums.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
