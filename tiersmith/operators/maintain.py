"""Results that are kept and brought up to date with later writes.

What a resolution needs of a log is, for each (entity, key, layer), the latest write
that has a value, and the latest null write if that is later still. This state
is far smaller than the log and merges: state(a + b) = merge(state(a), b), in
any order, with writes that come late or twice. Presence rules and layer orders
are applied when the state is read, so one state serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_KEYS = ("entity", "key", "layer")


def settings_state(log: DataFrame) -> DataFrame:
    """(entity, key, layer, seq, value, null_seq): the writes of a log that still matter.

    ``seq`` and ``value`` are null if there is no write with a value; ``null_seq`` is the latest null write if it
    comes after ``seq``, else null. Of equal ``seq`` the greatest value stays, as in ``latest_setting``. A null
    key is no key; a null entity or layer is one like any other.
    """
    write = F.max(F.when(F.col("value").isNotNull(), F.struct("seq", "value"))).alias("_ts_write")
    blank = F.max(F.when(F.col("value").isNull(), F.col("seq"))).alias("_ts_null")
    grouped = log.where(F.col("key").isNotNull()).groupBy(*STATE_KEYS).agg(write, blank)
    seq = F.col("_ts_write.seq")
    later = F.when(F.col("_ts_write").isNull() | (F.col("_ts_null") > seq), F.col("_ts_null"))
    return grouped.select(*STATE_KEYS, seq.alias("seq"), F.col("_ts_write.value").alias("value"), later.alias("null_seq"))


def state_writes(state: DataFrame) -> DataFrame:
    """A state as the log of its writes (entity, key, layer, seq, value), one or two for each key and layer. Every
    operator on a log gives the same for these as for the whole log, if it looks at the latest writes only."""
    writes = F.array(
        F.struct(F.col("seq").alias("seq"), F.col("value").alias("value")),
        F.struct(F.col("null_seq").alias("seq"), F.lit(None).cast(state.schema["value"].dataType).alias("value")),
    )
    return state.select(*STATE_KEYS, F.inline(F.filter(writes, lambda w: w["seq"].isNotNull())))


def merge_settings(state: DataFrame, writes: DataFrame) -> DataFrame:
    """The state after further ``writes``, a log or the writes of another state."""
    columns = [*STATE_KEYS, "seq", "value"]
    return settings_state(state_writes(state).select(*columns).unionByName(writes.select(*columns)))
