"""Token files: Parquet list columns in document order, for selective token and metadata reads.

A store is a folder of Parquet files in ascending order of document id. A row
holds ``doc_id, n_tokens, ids_crc32`` and the list column ``ids``. Ids are
dictionary-encoded (two bytes or less for a vocabulary of 50,000), the metadata
columns are delta-encoded, row groups and pages have set sizes, and the page
indexes that the writer adds let a reader skip pages by document id. Reading
metadata never touches the pages of ids, since columns are stored apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiersmith.llm.common import BATCH_ROWS, prepare, text_bytes
from tiersmith.llm.tokens import encoder, id_lists, merged

PART_BYTES = 32 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids) of every document, in ascending order of ids and texts.

    Whole texts are encoded, then ``end_id`` is appended; a null or empty text
    is the end id alone. A null document id sorts first. Repeated rows stay.
    The texts are range-partitioned by id, so each task encodes a run of
    documents and its output needs no further shuffle.
    """
    prepare(df.sparkSession)
    parts = max(1, -(-text_bytes(df, text) // part_bytes))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for batch in merged(it):
            lists = id_lists(ids_of.encode(batch.column("text").to_pylist()), end_id)
            ids = batch.column("doc_id").combine_chunks()
            yield from pa.Table.from_arrays([ids, lengths(lists), crc32s(lists), lists], names=["doc_id", "n_tokens", "ids_crc32", "ids"]).to_batches(BATCH_ROWS)

    return ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids_crc32 long, ids array<int>")


def lengths(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64))


def crc32s(lists: pa.ListArray) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    offsets = lists.offsets.to_numpy()
    data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B")
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], type=pa.int64())


def write_store(encoded: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write an encoded table as a store; a repeated write replaces the folder whole."""
    numbered = encoded.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "ids_crc32", "ids")
    (
        numbered.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false")  # integers of the second format version are then delta-encoded
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, n_tokens, ids_crc32, start) without reading any ids.

    ``start`` counts the ids of all documents before a document. Parts are runs
    of documents, so it is a running sum inside each part plus the total of the
    parts before; the totals are one row for each file.
    """
    rows = spark.read.parquet(path).select("part", "doc_id", "n_tokens", "ids_crc32")
    return _with_start(rows, rows)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(part, doc_id, n_tokens, ids_crc32, ids, start) of the documents with first <= doc_id <= last.

    The bounds reach the Parquet reader, which skips row groups and pages by
    their indexes; ``start`` still counts from the first document of the store.
    """
    rows = spark.read.parquet(path)
    chosen = rows
    if first is not None:
        chosen = chosen.where(F.col("doc_id") >= first)
    if last is not None:
        chosen = chosen.where(F.col("doc_id") <= last)
    if first is None and last is None:
        return _with_start(rows, rows.select("part", "n_tokens"))
    starts = read_metadata(spark, path).select("part", "doc_id", "ids_crc32", "start").where(F.lit(True) if first is None else F.col("doc_id") >= first)
    starts = starts.dropDuplicates(["part", "doc_id", "ids_crc32", "start"])
    return chosen.join(starts, ["part", "doc_id", "ids_crc32"]).dropDuplicates(["part", "doc_id", "start"])


def _with_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(totals, "part").withColumn("start", F.col("before") + F.col("_local")).drop("_local", "before")


def checked_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): length and checksum taken from the ids that are in the files."""
    prepare(spark)
    rows = spark.read.parquet(path).select("part", "doc_id", "ids")

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column("ids")
            lists = pa.concat_arrays([lists])  # offsets from 0
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), lengths(lists), crc32s(lists)], names=["part", "doc_id", "n_tokens", "ids_crc32"])

    measured = rows.mapInArrow(measure, "part int, doc_id long, n_tokens long, ids_crc32 long")
    sizes = spark.read.parquet(path).select("part", "n_tokens")
    return _with_start(measured, sizes).select("doc_id", "start", "n_tokens", "ids_crc32")
