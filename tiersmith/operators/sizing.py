"""CPU and memory requests of entities and their totals per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.functions.numbers import quantity
from tiersmith.functions.presence import ladder
from tiersmith.functions.sizes import MIB_TYPE, overhead_mib, whole_mib


def resource_requests(
    df: DataFrame,
    size: str = "size_text",
    runtime: str = "code",
    overheads: Sequence[str] = ("overhead_text",),
    factors: Sequence[str] = (),
) -> DataFrame:
    """Add ``size_mib``, ``size_ok``, ``overhead_mib`` and their sum
    ``request_mib``; rows without an explicit size have none of them."""
    mib = F.col("size_mib")
    extra = overhead_mib(mib, F.col(runtime), [F.col(c) for c in overheads], [F.col(c) for c in factors])
    given = F.col(size).isNotNull()
    sized = df.withColumn("_whole", whole_mib(F.col(size))).withColumns(
        {
            "size_mib": F.when(given, F.coalesce("_whole", F.lit(0).cast("bigint"))),
            "size_ok": F.when(given, F.col("_whole").isNotNull()),
        }
    )
    return (
        sized.withColumn("overhead_mib", F.when(mib.isNotNull(), extra))
        .withColumn("request_mib", mib.cast(MIB_TYPE) + F.col("overhead_mib"))
        .drop("_whole")
    )


def cpu_requests(
    df: DataFrame, requests: Sequence[str], limits: Sequence[str], default: str = "1"
) -> DataFrame:
    """Add ``cpu_request``, ``cpu_limit`` (exact) and ``cpu_ok``.

    The first of the columns ``requests`` that is set gives the request, else
    ``default`` does; the first of ``limits`` that is set gives the limit, which
    may be absent. A malformed text gives null and is not ok.
    """
    request = ladder([F.col(c) for c in requests], default)
    limit = ladder([F.col(c) for c in limits])
    texts = df.withColumns({"_request": request, "_limit": limit})
    sized = texts.withColumns({"cpu_request": quantity(F.col("_request")), "cpu_limit": quantity(F.col("_limit"))})
    ok = F.col("cpu_request").isNotNull() & (F.col("_limit").isNull() | F.col("cpu_limit").isNotNull())
    return sized.withColumn("cpu_ok", ok).drop("_request", "_limit")


def resource_rollup(
    df: DataFrame,
    group: Sequence[str] = ("grp",),
    instances: str = "instances",
    **requests: object,
) -> DataFrame:
    """Totals per group: entities, entities without an explicit size, entities
    with malformed size, instances and MiB over all instances (exact)."""
    sized = resource_requests(df, **requests)
    return sized.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("size_mib").isNull()).alias("n_unsized"),
        F.count_if(~F.col("size_ok")).alias("n_malformed"),
        F.sum(F.col(instances).cast("bigint")).alias("instances"),
        F.sum(F.col("request_mib") * F.col(instances).cast("decimal(10,0)")).alias("request_mib"),
    )
