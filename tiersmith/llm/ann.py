"""Approximate nearest neighbours by a permutation index.

Equal vectors are one class, which carries its smallest ids. Every class is
described by its nearest pivots, in order. The classes are dealt into shards; each shard posts its vectors in the inverted files of their pivots,
with the place of the pivot. A query adds up, over the files of its own pivots,
how much nearer each vector's order is to its own than that of a vector which
shares none: the footrule distance. The nearest part of the shard by footrule is
then ranked by the true measure, and the best classes give their ids. Queries
meet the shards in blocks, and the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, prepare
from tiersmith.llm.pivots import SAMPLE_ROWS, matrix, nearest, pivots_of, sample_vectors, spread, usable

PIVOTS = 256
PREFIX = 64
PART = 0.2
LEAST = 1_000
SHARD_ROWS = 32_768
BLOCK_ROWS = 4_096


def footrule_savings(query: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each of ``n`` vectors how far its footrule distance to the query's order is below the largest, halved.

    A pivot that is missing in an order counts as standing just after its end.
    """
    total = np.zeros(n, dtype=np.int32)
    length = len(query)
    for place, pivot in enumerate(query.tolist()):
        rows, places = files[pivot]
        total[rows] += length - np.maximum(places, place)
    return total


def inverted_files(order: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the vectors whose order holds it, and its place there."""
    n, length = order.shape
    by_pivot = np.argsort(order.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(order.ravel(), minlength=n_pivots))
    rows, places = (by_pivot // length).astype(np.int32), (by_pivot % length).astype(np.int32)
    return [(rows[a:b], places[a:b]) for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """With one more number, which makes all vectors equally long: then nearest means largest inner product."""
    return np.concatenate((x, np.sqrt(np.maximum(0, longest**2 - (x**2).sum(axis=1)))[:, None]), axis=1)


def _search(sample: list[list[float]], longest: float, k: int, n_pivots: int, prefix: int, part: float, least: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy().astype(bool)
        x, q = (matrix(rows["vector"].filter(pa.array(m))) for m in (~asks, asks))
        ids, query_ids = (rows["ids"].filter(pa.array(m)).combine_chunks().flatten().to_numpy() for m in (~asks, asks))
        count = pa.compute.list_value_length(rows["ids"]).to_numpy()[~asks].astype(np.int64)
        start = np.cumsum(count) - count
        query_keys = rows["key"].to_numpy()[asks]
        found: list[tuple] = []
        if len(x) and len(q):
            dim = x.shape[1]
            own = np.array([v for v in sample if len(v) == dim]).reshape(-1, dim)
            pivots = pivots_of(_lengthened(own, longest).tolist(), dim + 1, n_pivots)
            files = inverted_files(nearest(_lengthened(x, longest), pivots, prefix), n_pivots)
            orders = nearest(np.concatenate((q, np.zeros((len(q), 1))), axis=1), pivots, prefix)
            size = min(len(x), max(least, int(np.ceil(part * len(x)))))
            for i, order in enumerate(orders):
                near = np.arange(len(x))
                if size < len(x):
                    saved = footrule_savings(order, files, len(x))
                    near = np.flatnonzero(saved >= np.partition(saved, len(x) - size)[len(x) - size])
                near = near[(count[near] > 1) | (ids[start[near]] != query_ids[i])]
                score = x[near] @ q[i]
                if len(near) > k:
                    best = score >= np.partition(score, len(score) - k)[len(score) - k]
                    near, score = near[best], score[best]
                many = count[near]
                own = ids[np.repeat(start[near] + many - np.cumsum(many), many) + np.arange(many.sum())]
                score = np.repeat(score, many)[own != query_ids[i]]
                own = own[own != query_ids[i]]
                top = np.lexsort((own, -score))[:k]
                found.append((np.full(len(top), query_ids[i]), np.full(len(top), query_keys[i]), own[top], score[top]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "key": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    return run


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    n_pivots: int = PIVOTS,
    prefix: int = PREFIX,
    part: float = PART,
    least: int = LEAST,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each query row.

    ``is_query`` is a condition on the columns of ``df``. Of the distinct vectors
    of each shard the nearest ``part`` by footrule with all ties, and ``least`` at
    least, are ranked by inner product in double precision; ``part=1`` ranks all,
    which is exact. Copies of a vector share its place in the index.
    Ties go to the smaller id. Rows with the id of the query are not candidates.
    Rows equal in id and vector are one row, as a query, if one of them is, and as
    a candidate; rows that share only the id are queries and candidates each.
    Rows without an id, vectors that are null, empty, zero or hold a null or a
    number that is not finite take no part, and vectors of other lengths than
    the query's are not candidates. Pivots lie apart in a sample of distinct
    vectors; every one is indexed.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id", "vector").agg(F.max("asks").alias("asks"))
    rows = cut(rows.withColumn("dim", F.size("vector")))
    # Of equal vectors only the smallest ids can be among the best: k, and one that may be the query's own.
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    classes = cut(few.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0]))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = classes.agg(F.count("*"), F.max(norm)).first()
    n_queries = rows.where("asks").count()
    sample = spread(sample_vectors(classes, "first", "vector", SAMPLE_ROWS), n_pivots)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    key = F.xxhash64("vector")
    shard, block = F.pmod(key, F.lit(shards)).cast("int"), F.pmod(F.xxhash64(F.xxhash64("vec_id")), F.lit(blocks)).cast("int")
    index = classes.select("dim", "ids", "vector", key.alias("key"), F.lit(False).alias("asks"), shard.alias("shard"), each(blocks).alias("block"))
    asked = rows.where("asks").select("dim", F.array("vec_id").alias("ids"), "vector", key.alias("key"), F.lit(True).alias("asks"), each(shards).alias("shard"), block.alias("block"))
    run = _search(sample, float(longest or 0.0), k, n_pivots, prefix, part, least)
    found = index.unionByName(asked).groupBy("dim", "shard", "block").applyInArrow(run, "query_id long, key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
