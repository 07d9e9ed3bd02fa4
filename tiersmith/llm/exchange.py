"""Blocks of documents that learn from the whole corpus about the keys that they hold.

A block sends its distinct keys, sorted and with their counts, to buckets. A
bucket adds up all blocks and gives each block a value for each key it sent, in
the order sent. What moves are a block's distinct keys, not its text, and a key
that fills the corpus arrives once from each block. Keys travel as differences,
compressed.

A bucket never takes in more than ``fan`` blocks at once: beyond that, runs of
``fan`` blocks are merged first, level by level, and values come back the same way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import sorted_groups

FAN = 1_024
MESSAGE = "kind int, bucket int, node long, keys binary, counts binary"
REPLY = "kind int, bucket int, node long, reply binary, total long, distinct long"


def shut(values: np.ndarray) -> bytes:
    """Numbers as bytes: planes of equal significance one after the other, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def opened(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def shut_keys(keys: np.ndarray) -> bytes:
    return shut(np.diff(keys, prepend=np.uint64(0)))


def opened_keys(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data, np.uint64), dtype=np.uint64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all, sorted, and their summed counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    heads = sorted_groups(k)
    return k[heads], np.add.reduceat(c, heads) if len(heads) else c


def messages(kind: int, node: int, buckets: np.ndarray, keys: np.ndarray, counts: np.ndarray, n: int) -> list[tuple]:
    """A message to each of ``n`` buckets, empty where the block has no key for it."""
    order, edges = by_bucket(buckets, n)
    keys, counts = keys[order], counts[order]
    return [(kind, b, node, shut_keys(keys[x:y]), shut(counts[x:y].astype(np.int64))) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False))]


def by_bucket(buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys by bucket, and where each bucket begins and ends in it."""
    return np.argsort(buckets.astype(np.int32), kind="stable"), np.searchsorted(np.sort(buckets), np.arange(n + 1))


def message_table(rows: list[tuple]) -> pa.Table:
    kind, bucket, node, keys, counts = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "node": pa.array(node, pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _inputs(rows: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    return rows["node"].to_pylist(), [opened_keys(x) for x in rows["keys"].to_pylist()], [opened(x, np.int64) for x in rows["counts"].to_pylist()]


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    kind, bucket, node = (k.as_py() for k in key)
    _, keys, counts = _inputs(rows)
    k, c = merged(keys, counts)
    return message_table([(kind, bucket, node, shut_keys(k), shut(c))])


def _replies(kind: int, bucket: int, nodes: list[int], keys: list[np.ndarray], all_keys: np.ndarray, values: np.ndarray, total: int, distinct: int) -> pa.Table:
    out = [shut(values[np.searchsorted(all_keys, k)]) for k in keys]
    n = len(nodes)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "node": pa.array(nodes, pa.int64()), "reply": pa.array(out, pa.binary()), "total": pa.array([total] * n, pa.int64()), "distinct": pa.array([distinct] * n, pa.int64())})


def _answering(answer: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind, bucket = (k.as_py() for k in key)
        nodes, keys, counts = _inputs(rows)
        k, c = merged(keys, counts)
        return _replies(kind, bucket, nodes, keys, k, answer(kind, k, c), int(c.sum()), int((c > 0).sum()))

    return run


def _spreading(value_type: Callable[[int], type]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, below: pa.Table, above: pa.Table) -> pa.Table:
        kind, bucket, _ = (k.as_py() for k in key)
        nodes, keys, counts = _inputs(below)
        k, _ = merged(keys, counts)
        values = opened(above["reply"][0].as_py(), value_type(kind))
        return _replies(kind, bucket, nodes, keys, k, values, above["total"][0].as_py(), above["distinct"][0].as_py())

    return run


def ask(sent: DataFrame, n_nodes: int, answer: Callable[[int, np.ndarray, np.ndarray], np.ndarray], value_type: Callable[[int], type], fan: int = FAN) -> DataFrame:
    """Replies to messages: for each message the values of its keys, and the bucket's total and distinct keys that count.

    ``answer`` maps kind, distinct keys and summed counts to values of ``value_type(kind)``.
    """
    if n_nodes <= fan:
        return sent.groupBy("kind", "bucket").applyInArrow(_answering(answer), REPLY)
    up = F.floor(F.col("node") / fan).cast("long").alias("up")
    above = sent.select("kind", "bucket", up, "node", "keys", "counts").groupBy("kind", "bucket", "up").applyInArrow(_merge, MESSAGE)
    replies = ask(above, -(-n_nodes // fan), answer, value_type, fan).withColumnRenamed("node", "up")
    below = sent.withColumn("up", up).groupBy("kind", "bucket", "up")
    return below.cogroup(replies.groupBy("kind", "bucket", "up")).applyInArrow(_spreading(value_type), REPLY)
