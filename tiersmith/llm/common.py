"""What the operators of this package share: reading, hashing rows, Arrow batches, text bytes.

Documents travel as Arrow batches, and the work on their bytes is vectorised
over a whole batch. A *block* is a set of documents that one task can hold; its
number is a hash of the document id, so it is the same whenever it is computed.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersmith.session import ensure_checkpoint_dir

# Rows of one Arrow batch; long documents make a batch of many rows too large for a worker.
BATCH_ROWS = 400

WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE, END = 0x20, 0x0A

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and Python workers that give memory back and find this package where the driver did."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.sparkContext.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def lean_workers(spark: SparkSession) -> None:
    """Python workers from now on have one heap, and arrays of 1 MB and more go back to the system when they are freed.

    That costs time, so it is for chains of operators, whose workers would add up what each operator has left.
    """
    for name, value in (("MALLOC_ARENA_MAX", "1"), ("MALLOC_MMAP_THRESHOLD_", str(1 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(1 << 20))):
        spark.sparkContext.environment.setdefault(name, value)


_KEPT: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """What the tasks of ``owner`` keep in this worker from one to the next.

    A worker lives as long as its executor and serves one operator after the other. What others kept goes when
    ``owner`` takes its turn, and the memory that they freed goes back to the system.
    """
    if owner not in _KEPT:
        others = bool(_KEPT or _POWERS)
        _KEPT.clear()
        _POWERS.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if others else None
        if trim:
            trim(0)
        _KEPT[owner] = {}
    return _KEPT[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` in the folder of reliable checkpoints: computed once, without lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A folder for written tables, below the shared folder of checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables"


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., and the new name of each, so that no name inside an operator meets a caller's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


def remainder(col: Column, n: int) -> Column:
    """crc32 of a value as text, modulo ``n``; a null counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(df: DataFrame, col: str) -> int:
    """Bytes of a text column: one scan, one number."""
    return df.agg(F.sum(F.octet_length(F.coalesce(F.col(col), F.lit(""))))).first()[0] or 0


def blocked(df: DataFrame, doc_id: str, text: str, block_bytes: int, total: int | None = None) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and the number of blocks of about ``block_bytes`` each.

    Rows of one id share a block. A null id or text is kept as null.
    """
    total = text_bytes(df, text) if total is None else total
    n = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(n)).cast("int")
    out = df.select(block.alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return out, n


def string_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the offset of each row (one more than rows). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words (runs of bytes that are not white space) of each row."""
    data, offsets = string_buffer(texts)
    starts = np.ones(len(data), dtype=bool)
    white = _IS_WHITE[data]
    starts[1:] = white[:-1]
    starts[offsets[:-1][offsets[:-1] < len(data)]] = True
    total = np.concatenate(([0], np.cumsum(starts & ~white)))
    return total[offsets[1:]] - total[offsets[:-1]]


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as tokens: A-Z in lower case, words with one blank between them, END after the last.

    Returns the bytes of all rows and the offset of each row; a row ends with its END byte.
    """
    data, offsets = string_buffer(texts)
    low = _LOWER[data]
    low[_IS_WHITE[data]] = SPACE
    low = _squeeze(np.insert(low, offsets[1:], END))
    return low, np.concatenate(([0], np.flatnonzero(low == END) + 1))


def line_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines of all texts: words with one blank between them, END after each line.

    Returns the bytes and the number of lines of each row, which is at least one.
    """
    data, offsets = string_buffer(texts)
    white = _IS_WHITE[data] & (data != END)
    plain = np.where(white, np.uint8(SPACE), data)
    breaks = np.concatenate(([0], np.cumsum(data == END)))
    return _squeeze(np.insert(plain, offsets[1:], END)), breaks[offsets[1:]] - breaks[offsets[:-1]] + 1


def _squeeze(data: np.ndarray) -> np.ndarray:
    """Without blanks that stand before another, before END, or after END."""
    space = data == SPACE
    stop = space | (data == END)
    keep = ~space
    keep[:-1] |= ~stop[1:]
    data = data[keep]
    keep = data != SPACE
    keep[1:] |= data[:-1] != END
    if len(data):
        keep[0] = data[0] != SPACE
    return data[keep]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a stream."""
    breaks = np.flatnonzero((data == SPACE) | (data == END))
    starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else np.zeros(0, np.int64)
    word = breaks > starts  # an empty row has an end without a word
    return starts[word], breaks[word]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gets the hash of any span of ``data``, bytes or 64-bit hashes."""
    n = len(data)
    power, _ = powers(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return sums


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one value never meets another."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal content, equal hash, wherever it stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sorted_groups(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in sorted ``keys``."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def batches(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of bounded length."""
    full = pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
    for start in range(0, full.num_rows, rows):
        yield full.slice(start, rows)
