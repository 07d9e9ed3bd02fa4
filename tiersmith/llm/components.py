"""Connected components of a graph whose edges lie in a DataFrame.

Tasks first shrink what they hold to spanning stars (``stars``); the stars of
all tasks are then contracted by alternating large-star and small-star steps,
each a shuffle of the remaining edges with one row for each node and smaller
neighbour. No step collects more than one number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import cut


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges (a, b) as edges from each other node to the least of its component."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; ``component`` is its least reachable node.

    Edges may be repeated, in either direction, and point to themselves; edges
    with a null end are left out. Stops when a round changes nothing; by then
    every edge points from a node to the least node of its component.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = cut(edges.select(big.alias("a"), small.alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select("b", F.col("b").alias("component")).distinct()
            )
        seen = tuple(found)
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node move to its least neighbour or itself
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = edges.join(least, edges["b"] == least["n"]).select(F.col("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = large.join(low, large["a"] == low["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_star = moved.where("a <> b").unionAll(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        edges = cut(small_star.distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
