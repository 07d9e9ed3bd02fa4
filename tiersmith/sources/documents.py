"""Property documents as text files, and packed in Parquet."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = "line string, entity string, part int, block_start long, line_id long"


def write_documents(documents: DataFrame, path: str) -> None:
    """Write rendered documents as text, one folder per entity and part.

    Rows go to the task of their folder first, so a folder holds one file; parts
    of a large entity are spread over tasks.
    """
    text = F.regexp_replace("document", r"\n\z", "").alias("value")
    (
        documents.repartition("entity", "part")
        .select("entity", "part", text)
        .write.mode("overwrite")
        .partitionBy("entity", "part")
        .text(path)
    )


def write_packed(
    documents: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 32 << 20, page_rows: int = 1_000, expected: int | None = None
) -> None:
    """Write rendered documents as Parquet files in the order of (entity, part), for reading single entities.

    Ranges of entities go to ``files`` files (as many as Spark has shuffle
    partitions, unless stated), and the parts of a large entity spread over
    several. Sorted files make the ranges of row groups and pages narrow; a bloom filter
    on the entity, sized for ``expected`` entities of a row group, rules out those
    whose range an entity falls into by chance.
    """
    order = [F.col("entity"), F.col("part")]
    spread = documents.repartitionByRange(*order) if files is None else documents.repartitionByRange(files, *order)
    writer = (
        spread.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.bloom.filter.enabled#entity", "true")
    )
    if expected is not None:
        writer = writer.option("parquet.bloom.filter.expected.ndv#entity", expected)
    writer.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """All packed documents, (entity, part, n_lines, document)."""
    return spark.read.parquet(path)


def read_document(spark: SparkSession, path: str, entity: object) -> DataFrame:
    """The parts of one entity, in order. Files, row groups and pages without it are not read; a null entity is one too."""
    rows = read_packed(spark, path)
    wanted = F.col("entity").isNull() if entity is None else F.col("entity") == F.lit(entity)
    return rows.where(wanted).orderBy("part")


def read_compressed_lines(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Lines of gzip property files as ``read_property_lines`` gives them, and (path, reason) of the broken ones.

    Spark's own reader either stops at a broken file or silently keeps what comes before
    the break. Here each file is fetched as bytes and unpacked by itself, twice: once to
    find out whether it is whole, and then line by line. A file that is cut off or
    not UTF-8 gives no line and one row of the report; the others are not touched by it. A
    file is one task's, and its packed bytes are held in memory, so large files are for ``read_property_lines``.
    """
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select("path", "content")

    def lines_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                reason = broken(content)
                if reason:
                    yield pa.RecordBatch.from_pydict({"entity": [path], "line_id": [None], "line": [None], "reason": [reason]}, _LINES)
                    continue
                number = 0
                with gzip.open(io.BytesIO(content), "rt", encoding="utf-8", newline=None) as unpacked:
                    while some := list(islice(unpacked, _LINES_AT_ONCE)):
                        n = len(some)
                        text = [line.removesuffix("\n") for line in some]
                        yield pa.RecordBatch.from_pydict({"entity": [path] * n, "line_id": range(number, number + n), "line": text, "reason": [None] * n}, _LINES)
                        number += n

    found = files.mapInArrow(lines_of, "entity string, line_id long, line string, reason string")
    lines = found.where("reason is null").select("entity", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("block_start"), "line_id", "line")
    return lines, found.where("reason is not null").select(F.col("entity").alias("path"), "reason")


_LINES = pa.schema([("entity", pa.string()), ("line_id", pa.int64()), ("line", pa.string()), ("reason", pa.string())])
_LINES_AT_ONCE = 10_000


def broken(content: bytes) -> str | None:
    """Why a gzip file can't be read to its end as UTF-8 text, or None if it can."""
    try:
        with gzip.open(io.BytesIO(content), "rt", encoding="utf-8") as unpacked:
            while unpacked.read(1 << 20):
                pass
    except (EOFError, OSError, zlib.error, UnicodeDecodeError) as error:
        return f"{type(error).__name__}: {error}"
    return None


def read_property_lines(
    spark: SparkSession, paths: str | Sequence[str], base_path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Lines of property files, (entity, part, block_start, line_id, line), and
    the paths that could not be found, (path, reason).

    ``entity`` and ``part`` are taken from folders as ``write_documents`` lays
    them out; without such folders the entity is the file path. Large files are
    split between tasks, so a line number would need a pass of its own: lines
    of an entity are in order by (part, block_start, line_id). A path that does
    not exist costs only its own rows. A file that breaks off halfway, or goes
    while it is read, stops the job: nothing is shortened silently. See
    ``read_compressed_lines`` for packed files of which some may be broken.
    """
    reader = spark.read.options(ignoreMissingFiles=False, ignoreCorruptFiles=False)
    if base_path is not None:
        reader = reader.option("basePath", base_path)
    found, missing = [], []
    for path in [paths] if isinstance(paths, str) else list(paths):
        try:
            reader.text(path)
            found.append(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append((path, "not found"))
    unread = spark.createDataFrame(missing, "path string, reason string")
    if not found:
        return spark.createDataFrame([], LINE_SCHEMA).select("entity", "part", "block_start", "line_id", "line"), unread
    raw = reader.text(found)
    if "entity" in raw.columns:
        # Stated types, since an entity that looks like a number is still text.
        raw = reader.schema("value string, entity string, part int").text(found)
        entity, part = F.col("entity"), F.col("part")
    else:
        entity, part = F.col("_metadata.file_path"), F.lit(0)
    lines = raw.select(
        entity.alias("entity"),
        part.alias("part"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )
    return lines, unread
