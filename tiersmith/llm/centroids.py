"""Centroid clustering in exact integers, with an Orchard search for the nearest centroid.

Every centroid keeps a list of all centroids, nearest first. A vector starts at one
of them and reads its list. A centroid that is closer, or as close with a smaller
number, becomes the current one, and the search jumps to its list; centroids once
compared are marked and not compared again. It stops where the list lies strictly
beyond twice the current distance: by the triangle inequality nothing from there on
is as close as the current centroid. The start has no influence on the result.

A round is one scan: tasks assign their vectors and hand on a count and a sum for
each centroid, which Spark adds up. The driver gets ``k`` centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, prepare
from tiersmith.llm.pivots import matrix

#: Vectors that are searched at once.
SEARCH_ROWS = 4_096
_FAR = np.iinfo(np.int64).max


class Orchard:
    """Centroids (one row of 64-bit integers each) and the neighbour list of each."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        self.order = np.zeros((k, k + 1), dtype=np.int64)
        # squared, over four and rounded up: beyond twice a distance d means above d * d
        self.reach = np.full((k, k + 1), _FAR, dtype=np.int64)
        for c in range(k):
            squared = ((centroids - centroids[c]) ** 2).sum(axis=1)
            self.order[c, :k] = np.argsort(squared, kind="stable")
            self.reach[c, :k] = (squared[self.order[c, :k]] + 3) >> 2

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, ties to the smaller one, and the squared distance."""
        n = len(vectors)
        current, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        visited = np.zeros((n, len(self.centroids)), dtype=bool)
        visited[:, 0] = True
        distance = _squared(vectors - self.centroids[0])
        rows = np.arange(n)  # vectors still searching
        while len(rows):
            rows = rows[self.reach[current[rows], place[rows]] <= distance[rows]]
            other = self.order[current[rows], place[rows]]
            place[rows] += 1
            new = ~visited[rows, other]
            tried, other = rows[new], other[new]
            visited[tried, other] = True
            found = _squared(vectors[tried] - self.centroids[other])
            closer = (found < distance[tried]) | ((found == distance[tried]) & (other < current[tried]))
            moved = tried[closer]
            current[moved], distance[moved], place[moved] = other[closer], found[closer], 0
        return current, distance


def _squared(difference: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", difference, difference)


def whole(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` components, all of them finite numbers. Never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def whole_vectors(df: DataFrame, dim: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v as doubles) of the vectors that take part."""
    kept = df.where(whole(F.col(f"`{vector}`"), dim))
    return kept.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))


def to_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; an error where squared distances would leave 64 bits."""
    scaled = np.floor(vectors * scale)
    if scaled.size and np.abs(scaled).max() * 2 > (2.0**62 / scaled.shape[-1]) ** 0.5:
        raise ValueError("a vector component is too large for exact distances in 64 bits")
    return scaled.astype(np.int64)


def _searched(it: Iterator[pa.RecordBatch], lists: Orchard, scale: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors some thousand at a time: their rows, integers, clusters and squared distances."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def search():
        taken = pa.Table.from_batches(held)
        ints = to_integers(matrix(taken.column("v")), scale)
        return taken, ints, *lists.nearest(ints)

    for batch in it:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= SEARCH_ROWS:
            yield search()
            held, rows = [], 0
    if held:
        yield search()


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The ``k`` vectors (fewer if there are fewer) whose ``<seed>:<vec_id>`` has the smallest SHA-256, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name.cast("binary"), 256), "vec_id", "v").limit(k).collect()
    return to_integers(np.array([r["v"] for r in rows], dtype=np.float64), scale)


def moved_centroids(vectors: DataFrame, lists: Orchard, scale: int) -> np.ndarray:
    """Centroids after one round: floor(sum / count) of the vectors of each; those without vectors stay."""
    k, dim = lists.centroids.shape

    def add_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, ints, cluster, _ in _searched(it, lists, scale):
            np.add.at(sums, cluster, ints)
            counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        columns = [pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), type=pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    parts = vectors.mapInArrow(add_up, "cluster long, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("pos", "part"))
    totals = parts.groupBy("cluster", "pos").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("part", "n")])
    moved = lists.centroids.copy()
    for r in totals.collect():  # k * dim rows at most
        moved[r["cluster"], r["pos"]] = int(r["part"]) // int(r["n"])
    return moved


def assign(vectors: DataFrame, lists: Orchard, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; ``distance`` is squared."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for taken, _, cluster, distance in _searched(it, lists, scale):
            ids = taken.column("vec_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(search, f"vec_id {kind}, cluster int, distance long")


def cluster(
    df: DataFrame, k: int, rounds: int, dim: int, scale: int = 256, seed: str = "2", vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Components become floor(scale * x). ``k`` vectors chosen by hash are the first
    centroids; each round assigns all vectors and moves the centroids; then all are
    assigned once more. Only vectors of ``dim`` finite components take part: null
    vectors, other lengths, null, NaN and infinite components give no row. With fewer
    than ``k`` vectors there are as many centroids as vectors, and an empty table
    gives no rows. Repeated rows count once each and may be centroids side by side;
    equal centroids leave all vectors to the smaller number. A null id hashes as
    empty text and stays null. Other columns of ``df`` are not read, whatever their
    names. Components beyond 2**30 / sqrt(dim) after scaling raise an error.
    """
    prepare(df.sparkSession)
    vectors = whole_vectors(df, dim, vec_id, vector)
    centroids = first_centroids(vectors, k, scale, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not centroids.size:
        empty = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], empty)
    for _ in range(rounds):
        centroids = moved_centroids(vectors, Orchard(centroids), scale)
    assigned = cut(assign(vectors, Orchard(centroids), scale))
    per_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = sum(int(r["s"]) for r in per_cluster)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(r["cluster"], int(r["s"]), total, digests[r["cluster"]]) for r in per_cluster]
    told = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(told), "cluster")  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
