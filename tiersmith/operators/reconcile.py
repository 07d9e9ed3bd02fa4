"""Desired against existing state. A null in a key equals a null there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.operators.joins import keyed_join

CREATE = "create"
UPDATE = "update"


def wanted_rows(desired: DataFrame, keys: Sequence[str], payload: Sequence[str], seq: str | None = None) -> DataFrame:
    """(keys.., payload..) of the desired rows; where keys repeat, of the one with the largest ``seq``."""
    if seq is None:
        return desired.select(*keys, *payload)
    top = F.max(F.struct(seq, *payload)).alias("_ts_top")
    return desired.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_ts_top.{c}").alias(c) for c in payload])


def upsert_plan(
    desired: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = ("ns", "name"),
    payload: Sequence[str] = ("payload",),
    seq: str | None = None,
) -> DataFrame:
    """(keys.., action, payload..) for every desired row: ``create`` if the key
    does not exist, else ``update``, also when the payload is equal.

    Keys may repeat in ``desired`` if ``seq`` is given; the largest one wins.
    Existing rows that are not desired do not appear: nothing is deleted.
    """
    known = existing.select(*keys, F.lit(True).alias("_ts_exists"))
    joined = keyed_join(wanted_rows(desired, keys, payload, seq), known, keys, "left")
    action = F.when(F.col("_ts_exists"), UPDATE).otherwise(CREATE)
    return joined.select(*keys, action.alias("action"), *payload)


def apply_plan(
    plan: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = ("ns", "name"),
    payload: Sequence[str] = ("payload",),
) -> DataFrame:
    """State after the plan. An update replaces the payload columns only; other
    columns, and rows without a plan, stay as they are.

    Only the keys and the payload of a plan matter here, so desired rows with
    unique keys do as well and save the join that finds the actions."""
    return reconcile(plan, existing, keys, payload).select(*existing.columns)


def reconcile(
    desired: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = ("ns", "name"),
    payload: Sequence[str] = ("payload",),
    seq: str | None = None,
) -> DataFrame:
    """Plan and resulting state by one full join: the columns of ``existing`` and ``_ts_action``, which is ``create``,
    ``update``, or null where nothing is desired."""
    wanted = wanted_rows(desired, keys, payload, seq)
    planned = wanted.select(*keys, *[F.col(c).alias(f"_ts_new_{c}") for c in payload], F.lit(True).alias("_ts_planned"))
    joined = keyed_join(existing.withColumn("_ts_exists", F.lit(True)), planned, keys, "full")
    replaced = {c: F.when(F.col("_ts_planned"), F.col(f"_ts_new_{c}")).otherwise(F.col(c)) for c in payload}
    action = F.when(F.col("_ts_planned"), F.when(F.col("_ts_exists"), UPDATE).otherwise(CREATE))
    return joined.withColumns({**replaced, "_ts_action": action}).select(*existing.columns, "_ts_action")
