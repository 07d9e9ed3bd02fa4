"""SimHash near-duplicates found by meeting in the middle of the Hamming ball.

Of three differing bits at least one lies in some third of the 64 bits; with
that third masked, two differences at most are left. So every distinct
fingerprint, with each third masked in turn, emits what is left and all its
variants with one bit flipped: half the radius. Two fingerprints within the
radius share a variant that lies between them, and those that share one are
verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, kept_by, plain_names, prepare, sorted_groups, token_stream, word_spans
from tiersmith.llm.components import components, stars

SEED = 42
KEY_ROWS = 1_000_000
_SUM_ROWS = 1 << 16


def shingle_spans(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every shingle of ``k`` words; a row of fewer words is one shingle."""
    starts, ends = word_spans(data)
    row = np.searchsorted(offsets, starts, side="right") - 1
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(per_row) - per_row
    at = np.arange(len(starts))
    last = np.minimum(at + k - 1, first[row] + per_row[row] - 1)
    keep = (last == at + k - 1) | (at == first[row])
    return row[keep], starts[keep], ends[last[keep]]


def simhash(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """64-bit SimHash of each row of a token stream, as unsigned integers."""
    row, starts, ends = shingle_spans(data, offsets, k)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    n_rows = len(offsets) - 1
    sums = np.zeros((n_rows, 64), dtype=np.int64)
    for a in range(0, len(hashes), _SUM_ROWS):
        part = row[a : a + _SUM_ROWS]
        bits = np.unpackbits(hashes[a : a + _SUM_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = sorted_groups(part)
        for x, y in zip(heads, [*heads[1:], len(part)], strict=True):
            sums[part[x]] += bits[x:y].sum(axis=0, dtype=np.uint32)
    count = np.bincount(row, minlength=n_rows)
    return np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(df: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit integer) of every row; a text without words has 0."""
    prepare(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def compute(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        for batch in it:
            found = simhash(*token_stream(batch.column("text")), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(compute, "doc_id long, fingerprint long")


def variants(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all values, and the place of the value of each key.

    ``radius`` differences fall into ``radius`` parts of the 64 bits. For every
    part that is masked, at least one difference may be in it; the ball of half
    the others, rounded up, is emitted around what is kept. ``radius`` is from 0 to 3.
    """
    if radius > 3:
        raise ValueError("a radius above 3 needs balls of more than one bit")
    if radius < 3:  # both ends emit a ball of one bit, which meets at two differences
        masks = [0]
    else:
        edges = [0, 22, 43, 64]
        masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    flips = [[0] + [1 << b for b in range(64) if radius and not m >> b & 1] for m in masks]
    keys = [(values[:, None] & ~np.uint64(m)) ^ np.array(f, dtype=np.uint64)[None, :] for m, f in zip(masks, flips, strict=True)]
    keys = np.concatenate(keys, axis=1)
    return keys.ravel(), np.repeat(np.arange(len(values)), keys.shape[1])


def close_pairs(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of all pairs of values that share a key and differ in at most ``radius`` bits."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.arange(len(keys))
    step = 1
    while True:  # each value against the one ``step`` places on, while any group is that long
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        a, b = values[at], values[at + step]
        close = np.bitwise_count(a ^ b) <= radius
        close &= a != b
        if close.any():
            found.append((a[close], b[close]))
        if len(found) > 64:
            found = [stars(*map(np.concatenate, zip(*found, strict=True)))]
        step += 1
    if not found:
        return keys[:0], keys[:0]
    return stars(*map(np.concatenate, zip(*found, strict=True)))


def near_components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``prints`` (doc_id, fingerprint) with component_id, the least document id reachable by links.

    Equal fingerprints are one node, so copies meet in an aggregate and never in
    pairs. Fingerprints link at ``radius`` or fewer differing bits. Documents of
    a null id count, but name no component unless it holds nothing else.
    """
    prints = cut(prints)
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            values = batch.column("fingerprint").to_numpy().view(np.uint64)
            for a in range(0, len(values), 2_000):
                part = values[a : a + 2_000]
                keys, place = variants(part, radius)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[place].view(np.int64))], names=["key", "value"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("key").to_numpy(), b.column("value").to_numpy()) for b in it]
        if held:
            keys, values = map(np.concatenate, zip(*held, strict=True))
            a, b = close_pairs(keys.view(np.uint64), values.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    parts = max(1, -(-nodes.count() * 132 // KEY_ROWS))
    keyed = nodes.select("fingerprint").mapInArrow(emit, "key long, value long")
    edges = keyed.repartition(parts, "key").mapInArrow(meet, "a long, b long")
    member = components(edges).select(F.col("node").alias("fingerprint"), "component")
    rooted = nodes.join(member, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def simhash_components(df: DataFrame, k: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as hex, component_id) of all documents."""
    found = near_components(fingerprints(df, k, doc_id, text), radius)
    return found.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, k: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with all its columns, and of each component the document of least id.

    Rows that share that id are one document and stay together. Rows of a null
    id stay only where their component has no other document.
    """
    names = df.columns
    df, new = plain_names(df)
    found = near_components(fingerprints(df, k, new[doc_id], new[text]), radius)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return df.join(first, F.col(new[doc_id]).cast("long").eqNullSafe(F.col("_first")), "left_semi").toDF(*names)
