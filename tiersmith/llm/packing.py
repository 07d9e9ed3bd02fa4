"""Packing documents into sequences by minimum bin slack.

Only the histogram of lengths decides what a sequence holds, and it has at most
``capacity`` rows whatever the corpus. The plan is made on it: take the longest
length that is left, find by subset-sum over bitsets the fullest combination
that goes with it, remove the combination as many times as the histogram allows,
and repeat. Each entry of the plan is a combination and its number of copies, so
the plan is as small as the histogram. Pieces find their place by their rank
among the pieces of their length, which two counts give without gathering a
length in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, plain_names, prepare
from tiersmith.llm.tokens import encoder, merged

RANK_ROWS = 1_000_000


class Pattern(NamedTuple):
    """``copies`` sequences that hold the same ``lengths``, longest first."""

    lengths: tuple[int, ...]
    copies: int


def fullest(counts: dict[int, int], room: int, long_first: bool = True) -> list[int]:
    """Lengths, at most ``counts`` of each, with the largest sum that is not above ``room``.

    Bit s of a bitset says that sum s can be made. Lengths are added in order,
    each in groups of 1, 2, 4, ... copies; going back through the bitsets a
    group is used only where the sum can't be made without it, so the lengths
    that were added first are preferred.
    """
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=long_first):
        left, group = min(counts[length], room // length), 1
        while left:
            group = min(group, left)
            steps.append((length, group, reach))
            reach |= (reach << (length * group)) & mask
            left -= group
            group *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, group, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * group
            total -= length * group
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up the histogram exactly: the better of preferring long and short lengths."""
    return min((_plan(histogram, capacity, x) for x in (True, False)), key=lambda p: sum(x.copies for x in p))


def _plan(histogram: dict[int, int], capacity: int, long_first: bool) -> list[Pattern]:
    left = {length: n for length, n in sorted(histogram.items()) if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        lengths = [longest, *fullest(left, capacity - longest, long_first)]
        left[longest] += 1
        used = {x: lengths.count(x) for x in lengths}
        copies = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * copies
            if not left[x]:
                del left[x]
        out.append(Pattern(tuple(sorted(lengths, reverse=True)), copies))
    return out


def pieces_of(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_words: int | None = None,
    take_chars: int | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids with ``end_id`` after them, cut where too long.

    A document of more than ``capacity`` ids is cut into pieces of that size;
    what doesn't fill one is the first piece. A null or empty text is the end id alone.
    ``keep_words`` and ``take_chars`` bound a worker's memory: the words it keeps and
    the characters it encodes at once (null: those of ``tokens``). They change no result.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, keep_words, take_chars)
        for batch in merged(it, chars=take_chars):
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                marks = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                view = memoryview(ids)
                out += [(doc, k, a, b - a, zlib.crc32(view[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(marks, marks[1:]))]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int, length: str = "length", rank_rows: int = RANK_ROWS) -> DataFrame:
    """``items`` with sequence_id and offset: every item has a place, sequences are gapless and at most ``capacity`` long.

    Items of equal length are interchangeable; they are ranked by a hash of
    their row, rows equal in all columns by the order in which they come. The
    items are checkpointed, since they are used twice. An empty table gives
    no rows. A null length, or one outside 1..capacity, is an error. The new
    columns replace columns of their names; no other name matters.
    """
    items, new = plain_names(cut(items))
    length = new[length]
    histogram = {r[0]: r["count"] for r in items.groupBy(length).count().collect()}  # at most ``capacity`` rows
    n_items = sum(histogram.values())
    if any(x is None for x in histogram):
        raise ValueError("a length is null")
    spark = items.sparkSession
    slots, first = [], 0
    taken = dict.fromkeys(histogram, 0)
    for lengths, copies in plan(histogram, capacity):
        places: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            places.setdefault(x, []).append(at)
            at += x
        for x, offsets in places.items():
            slots.append((x, taken[x], taken[x] + copies * len(offsets), first, offsets))
            taken[x] += copies * len(offsets)
        first += copies
    # One row for each length, with its runs of ranks in order.
    runs = spark.createDataFrame(slots, "_len long, _from long, _to long, _first long, _offsets array<int>").groupBy("_len").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_first", "_offsets"))).alias("_runs"))
    buckets = max(1, -(-n_items // rank_rows))
    keyed = items.withColumn("_hash", F.xxhash64(*items.columns)).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    order = Window.partitionBy(length, "_bucket").orderBy("_hash")
    sums = keyed.groupBy(F.col(length).alias("_l"), F.col("_bucket").alias("_b")).count()
    earlier = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_l", "_b", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(sums, (F.col(length) == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).join(F.broadcast(runs), F.col(length) == F.col("_len"))  # the plan: at most a few thousand rows
    run = F.filter("_runs", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_to"]))[0]
    placed = ranked.withColumn("_run", run).withColumn("_nth", F.col("_rank") - F.col("_run._from"))
    slots_each = F.size("_run._offsets")
    return placed.select(
        *[F.col(c).alias(name) for name, c in new.items() if name not in ("sequence_id", "offset")],
        (F.col("_run._first") + F.floor(F.col("_nth") / slots_each)).cast("long").alias("sequence_id"),
        F.element_at("_run._offsets", (F.col("_nth") % slots_each + 1).cast("int")).cast("long").alias("offset"),
    )


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_words: int | None = None,
    take_chars: int | None = None,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    A null or empty text is the end id alone, a text of any length is cut into pieces, repeated rows are pieces each
    and ties are placed in any order; a null id stays null. An empty table gives no rows. Columns of ``df`` other than
    the two named are not read. ``keep_words`` and ``take_chars`` are those of ``pieces_of``.
    """
    return pack(pieces_of(df, tokenizer, end_id, capacity, doc_id, text, keep_words, take_chars), capacity)
