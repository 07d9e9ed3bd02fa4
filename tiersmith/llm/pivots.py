"""Reference points, and vectors described by their order of nearness."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that pivots are chosen from, and the largest cosine between two pivots.
SAMPLE_ROWS = 2_048
APART = 0.8


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and holds only finite numbers. Never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def sample_vectors(df: DataFrame, key: str, vector: str, n: int) -> list[list[float]]:
    """``n`` vectors at most, those whose key has the least hash: the sample that pivots are taken from."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return [r["v"] for r in rows.orderBy(F.xxhash64("k"), "k").limit(n).collect()]


def pivots_of(sample: list[list[float]], dim: int, n: int, seed: int = 5) -> np.ndarray:
    """``n`` unit vectors of ``dim`` numbers: those of the sample, then random directions."""
    own = [v for v in sample if len(v) == dim][:n]
    found = np.array(own, dtype=np.float64).reshape(len(own), dim)
    more = np.random.default_rng([seed, dim]).normal(size=(n - len(own), dim))
    found = np.concatenate((found, more))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def spread(sample: list[list[float]], n: int) -> list[list[float]]:
    """``n`` vectors of a sample at most for each dimension, chosen to lie apart.

    Each is the one that is farthest from those before it. None has a cosine
    above ``APART`` with another, so a crowded group owns one or a few of them,
    whatever its share of the sample.
    """
    out = []
    for dim in sorted({len(v) for v in sample}):
        own = [v for v in sample if len(v) == dim]
        unit = np.array(own, dtype=np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        closest, at = np.full(len(own), -np.inf), 0
        for _ in range(min(n, len(own))):
            out.append(own[at])
            closest = np.maximum(closest, unit @ unit[at])
            at = int(np.argmin(closest))
            if closest[at] > APART:
                break
    return out


def nearest(vectors: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest pivots of each vector, nearest first; ties to the smaller number."""
    sim = vectors @ pivots.T
    n = min(n, len(pivots))
    some = np.sort(np.argpartition(-sim, n - 1, axis=1)[:, :n], axis=1)
    order = np.argsort(-np.take_along_axis(sim, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks() if vectors.num_chunks != 1 else vectors.chunk(0)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)
