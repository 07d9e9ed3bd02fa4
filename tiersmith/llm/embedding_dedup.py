"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest pivots, in order, and posted in the
inverted list of each of them. Vectors of one list that share enough pivots are
verified by cosine; a pair that meets in several lists is judged in the list of
its smallest shared pivot only. Equal vectors are one class, so copies never
meet as pairs. A long list is cut into chunks, and each pair of chunks is a task
of its own, which returns a count for each vector and spanning edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, prepare
from tiersmith.llm.components import components, stars
from tiersmith.llm.pivots import SAMPLE_ROWS, matrix, nearest, pivots_of, sample_vectors, spread, usable

PIVOTS = 128
PREFIX = 8
SHARED = 2
CHUNK = 1024


def _post(sample: list[list[float]], n_pivots: int, prefix: int) -> Callable:
    def run(it):
        for batch in it:
            vectors = batch.column("vector")
            dims = pa.compute.list_value_length(vectors).to_numpy()
            for dim in np.unique(dims):
                here = batch.filter(pa.array(dims == dim))
                x = matrix(here.column("vector"))
                order = nearest(x, pivots_of(sample, int(dim), n_pivots), prefix)
                yield pa.RecordBatch.from_arrays(
                    [here.column("class"), here.column("label"), here.column("vector"), here.column("n"), pa.array([int(dim)] * len(x), pa.int32()), pa.array(list(order.astype(np.int16)), pa.list_(pa.int16()))],
                    names=["class", "label", "vector", "n", "dim", "order"],
                )

    return run


def _judge(threshold: float, shared: int, n_pivots: int) -> Callable:
    """Links inside a chunk, or between two chunks, of one list."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pivot, i, j = (k.as_py() for k in key[2:])
        x = matrix(rows["vector"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        order = np.stack(rows["order"].to_numpy()).astype(np.int64)
        ids, n, chunk = (rows[c].to_numpy() for c in ("class", "n", "chunk"))
        has = np.zeros((len(x), n_pivots), dtype=np.float32)
        np.put_along_axis(has, order, 1.0, axis=1)
        low = has[:, :pivot]  # a pair that shares one of these is judged there
        left, right = (np.flatnonzero(chunk == c) for c in (i, j))
        count = has[left] @ has[right].T
        near = (count >= shared) & (low[left] @ low[right].T == 0)
        near &= x[left] @ x[right].T >= threshold
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        once = a < b if i == j else np.ones(len(a), bool)
        a, b = a[once], b[once]
        links = np.bincount(a, n[b], len(x)) + np.bincount(b, n[a], len(x))
        linked = np.flatnonzero(links)
        p, q = stars(ids[a], ids[b])
        none = pa.nulls(len(linked), pa.int64())
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(ids[linked], pa.int64()), pa.array(p, pa.int64())]),
                "b": pa.concat_arrays([none, pa.array(q, pa.int64())]),
                "links": pa.concat_arrays([pa.array(links[linked].astype(np.int64)), pa.nulls(len(p), pa.int64())]),
            }
        )

    return run


def near_embeddings(
    df: DataFrame,
    threshold: float = 0.93,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    n_pivots: int = PIVOTS,
    prefix: int = PREFIX,
    shared: int = SHARED,
    chunk: int = CHUNK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Only rows of equal labels that are not null are compared. A vector that is
    null, empty, zero, or holds a null or a number that is not finite links with
    nothing, as do vectors of different lengths. Rows that repeat an id count
    each for itself; a null id names no component unless it holds nothing else.
    The pivots lie apart in a sample of distinct vectors, so that a group of near
    copies owns few of them however large it is; all rows are indexed.
    Found links are exact; a link is missed only if its two vectors share fewer
    than ``shared`` of their ``prefix`` nearest pivots.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    good = rows.where("ok")
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    sample = spread(sample_vectors(classes, "first", "vector", SAMPLE_ROWS), n_pivots)
    kinds = {f.name: f.dataType for f in classes.schema}
    schema = f"class long, label {kinds['label'].simpleString()}, vector {kinds['vector'].simpleString()}, n long, dim int, order array<short>"
    described = classes.select("class", "label", "vector", "n").mapInArrow(_post(sample, n_pivots, prefix), schema)
    posted = described.withColumn("pivot", F.explode("order"))
    sizes = described.select("label", "dim", F.explode("order").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    placed = posted.join(sizes, ["label", "dim", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    other = other.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    group = other.select("label", "dim", "pivot", "i", "j", "class", "vector", "n", "order", "chunk").groupBy("label", "dim", "pivot", "i", "j")
    found = cut(group.applyInArrow(_judge(threshold, shared, n_pivots), "a long, b long, links long"))

    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    # Least ids name components, so nodes are classes and their first ids come after.
    member = components(found.where("b is not null").select("a", "b"))
    named = classes.join(links, classes["class"] == links["a"], "left").join(member, classes["class"] == member["node"], "left")
    named = named.select("label", "vector", "first", "n", "links", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select(F.col("label").alias("_l"), F.col("vector").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(named, F.col("ok") & (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")), "left")
    component = F.when(F.col("_l").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
