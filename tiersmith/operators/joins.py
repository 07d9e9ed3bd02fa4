"""Joins that stay even when one key holds much of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HASH = "_ts_hash"
_BUCKET = "_ts_bucket"


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = False
) -> DataFrame:
    """Equi-join on ``keys`` in which Spark can split a hot key of ``left``.

    Spark broadcasts a small ``right`` as usual. Beyond that size it splits hot
    keys between the two shuffles of the join, which an aggregate by the same
    keys would not have: its rows are in place already and all left rows of a
    key would meet them in one task. A hash of the keys as a further join key
    changes no result, and makes Spark shuffle both sides for the join. With
    ``null_safe`` a null key equals a null key; the columns are those of ``left``
    then, as in a semi or anti join.
    """
    marked = F.xxhash64(*keys)
    if null_safe:
        other = right.select(*[F.col(k).alias(f"_ts_r_{k}") for k in keys], marked.alias("_ts_r_hash"))
        same = [F.col(k).eqNullSafe(F.col(f"_ts_r_{k}")) for k in keys]
        return left.withColumn(_HASH, marked).join(other, [*same, F.col(_HASH) == F.col("_ts_r_hash")], how).select(*left.columns)
    joined = left.withColumn(_HASH, marked).join(right.withColumn(_HASH, marked), [*keys, _HASH], how)
    return joined.drop(_HASH)


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join (inner, left or full) on ``keys`` in which a null key equals a null key.

    Returns the keys, the other columns of ``left`` and those of ``right``. A key
    that stands on one side only is taken from there, so a full join has its keys
    too. Hot keys of ``left`` can be split as in ``split_join``, but not in a full join.
    """
    marked = F.xxhash64(*keys)
    other = right.select(
        *[F.col(k).alias(f"_ts_r_{k}") for k in keys],
        marked.alias("_ts_r_hash"),
        *[c for c in right.columns if c not in keys],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_ts_r_{k}")) for k in keys]
    joined = left.withColumn(_HASH, marked).join(other, [*same, F.col(_HASH) == F.col("_ts_r_hash")], how)
    found = [F.coalesce(F.col(k), F.col(f"_ts_r_{k}")).alias(k) for k in keys]
    return joined.select(*found, *[c for df in (left, right) for c in df.columns if c not in keys])


def interval_join(
    items: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    first: str | None = None,
    last: str = "last_pos",
    bucket: int = 1_024,
) -> DataFrame:
    """Items with the spans of the same ``keys`` that hold their position: ``first`` <= ``pos`` <= ``last``.

    Positions count from 1, and a span without ``first`` begins there. Positions are
    cut into buckets of ``bucket``; a span is repeated for each bucket that it
    touches, and the bucket is a further key of a hash or merge join. So a span
    costs one row for every ``bucket`` items it holds, and a key with very many
    spans meets ``bucket`` items at a time and can be split among tasks. The two
    sides share no column names but the keys; null keys and empty spans join nothing.
    """
    start = F.lit(1).cast("bigint") if first is None else F.col(first).cast("bigint")
    end = F.col(last).cast("bigint")

    def number(place: Column) -> Column:
        return F.floor((place - 1) / F.lit(bucket)).cast("bigint")

    touched = F.explode(F.sequence(number(start), number(end)))
    wide = spans.where(end >= start).withColumn(_BUCKET, touched)
    placed = items.withColumn(_BUCKET, number(F.col(pos).cast("bigint")))
    joined = split_join(wide, placed, [*keys, _BUCKET], "inner")
    return joined.where((F.col(pos) >= start) & (F.col(pos) <= end)).drop(_BUCKET)
