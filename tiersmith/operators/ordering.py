"""Ordered work inside groups that may be far larger than one task.

A window over a group runs in one task. That is fine until one entity owns a
third of the table. Groups with more rows than one window should hold are range
partitioned by their order columns instead: every range is its own window, and
the totals of the earlier ranges of the group are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.session import ensure_checkpoint_dir

# Rows of one window.
BUCKET_ROWS = 2_000_000
# Items of one list, map or document; see ``part_of``.
PART_ROWS = 100_000

_RANGE = "_ts_range"
_BEFORE = "_ts_before"
_STEP = "_ts_step"
_TIE = "_ts_tie"
_FILE = "_ts_file"
_BLOCK = "_ts_block"
_ID = "_ts_id"


class HotGroups(NamedTuple):
    """Groups with more than ``bucket_rows`` rows, one row each, and the ranges that their rows need."""

    table: DataFrame
    group: tuple[str, ...]
    ranges: int


def part_of(pos: Column, part_rows: int) -> Column:
    """Part of a list that the item at ``pos`` (from 1) belongs to, the same rule for every group."""
    return F.floor((pos - 1) / F.lit(part_rows)).cast("int")


def hot_groups(df: DataFrame, group: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> HotGroups | None:
    """Groups with more than ``bucket_rows`` rows; None when there are none.

    One aggregate of the group columns, which combines before its shuffle. The
    answer is needed before the plan can be built, so this runs a job; the table
    of hot groups, which has fewer rows than the input by ``bucket_rows``, is
    checkpointed so that every use of it sees the same groups.
    """
    counts = df.groupBy(*group).agg(F.count("*").alias("_ts_n")).where(F.col("_ts_n") > bucket_rows)
    ensure_checkpoint_dir(df.sparkSession)
    counts = counts.checkpoint()
    ranges = counts.agg(F.sum(F.ceil(F.col("_ts_n") / bucket_rows))).first()[0]
    return HotGroups(counts.select(*group), tuple(group), int(ranges)) if ranges else None


def _join_groups(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null, keeping the columns of ``df``."""
    renamed = right.withColumnsRenamed({k: f"_ts_r_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_ts_r_{k}")) for k in keys]
    return df.join(renamed, condition, how).drop(*[f"_ts_r_{k}" for k in keys])


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    step: Column,
    out: str,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Running sum of ``step`` inside each group, in ascending order.

    Without hot groups this is a plain window. The rows of hot groups are range
    partitioned and checkpointed once; rows that are equal in all order columns
    are told apart by a hash of the row and then by where they stand, so copies
    of one order value spread over ranges too.
    """
    stepped = df.withColumn(_STEP, step.cast("bigint"))
    rows = (Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(*rows)
    if hot is None:
        return stepped.withColumn(out, F.sum(_STEP).over(within)).drop(_STEP)

    plain = _join_groups(stepped, hot.table, group, "left_anti").withColumn(out, F.sum(_STEP).over(within))

    place = [*group, *order, _TIE, f"{_TIE}2"]
    tied = _join_groups(stepped, hot.table, group, "left_semi").withColumns(
        {_TIE: F.xxhash64(*df.columns), f"{_TIE}2": F.monotonically_increasing_id()}
    )
    ranged = tied.repartitionByRange(hot.ranges, *place).withColumn(_RANGE, F.spark_partition_id()).checkpoint()
    keys = [*group, _RANGE]
    inside = Window.partitionBy(*keys).orderBy(*order, _TIE, f"{_TIE}2").rowsBetween(*rows)
    totals = ranged.groupBy(*keys).agg(F.sum(_STEP).alias(_STEP))
    earlier = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn(_BEFORE, F.coalesce(F.sum(_STEP).over(earlier), F.lit(0))).drop(_STEP)
    split = _join_groups(ranged.withColumn(out, F.sum(_STEP).over(inside)), before, keys, "inner")
    split = split.withColumn(out, F.col(out) + F.col(_BEFORE))
    columns = [*[F.col(f"`{c}`") for c in df.columns if c != out], out]
    return plain.select(*columns).unionByName(split.select(*columns))


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str = "pos",
    bucket_rows: int = BUCKET_ROWS,
    sizing: DataFrame | None = None,
    group_limit: int | None = None,
) -> DataFrame:
    """Number the rows of each group 1..n in ascending order, at any group size.

    Rows that are equal in all order columns get their numbers in any order.
    Where ``df`` is costly to compute, ``sizing`` names a cheaper table with at
    least its rows, in which to look for large groups. ``group_limit`` is for a
    caller that knows how many rows a group has at most: up to ``bucket_rows``
    nothing needs to be looked for.
    """
    if group_limit is not None and group_limit <= bucket_rows:
        return running_total(df, group, order, F.lit(1), out)
    hot = hot_groups(df if sizing is None else sizing, group, bucket_rows)
    return running_total(df, group, order, F.lit(1), out, hot)


def row_positions(df: DataFrame, out: str = "row_pos", most_splits: int = 1_000_000) -> DataFrame:
    """Number the rows of ``df`` 1..n in the order in which they stand in its files: by path, then by place in the file.

    Two passes and no window: the first counts the rows of each split of a file
    that a task reads, the second adds the rows of the splits before. The driver gets
    one row for each split and hands back as many; they are broadcast up to
    ``most_splits`` (40 bytes each) and joined otherwise. The numbers are the same on
    every run over the same files, however many tasks read them. Rows that do not
    come straight from files, as after a shuffle, stand in the order of their
    partitions, and are checkpointed first so that both passes see the same.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "Scan ExistingRDD" in plan:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint()
    try:
        from_files = df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))
    except AnalysisException:
        from_files = df.select("*", F.lit("").alias(_FILE), F.lit(0).cast("bigint").alias(_BLOCK))
    tagged = from_files.withColumn(_ID, F.monotonically_increasing_id())
    task = F.shiftright(_ID, 33).cast("int").alias(_RANGE)
    splits = tagged.groupBy(task, _FILE, _BLOCK).agg(F.count("*").alias("n"), F.min(_ID).alias("least")).collect()
    shifts, before = [], 1
    for r in sorted(splits, key=lambda r: (r[_FILE], r[_BLOCK], r[_RANGE])):
        shifts.append((r[_RANGE], r[_FILE], r[_BLOCK], before - r["least"]))
        before += r["n"]
    table = df.sparkSession.createDataFrame(shifts, f"{_RANGE} int, {_FILE} string, {_BLOCK} bigint, {_BEFORE} bigint")
    table = table.withColumn(_FILE, F.xxhash64(_FILE))  # told apart by the task and the place too
    table = F.broadcast(table) if len(shifts) <= most_splits else table
    joined = tagged.withColumns({_RANGE: task, _FILE: F.xxhash64(_FILE)}).join(table, [_RANGE, _FILE, _BLOCK])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], (F.col(_ID) + F.col(_BEFORE)).alias(out))
