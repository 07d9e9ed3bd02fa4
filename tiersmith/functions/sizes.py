"""Memory size text (``512m``, ``2G``) to MiB, and the overhead on top of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiersmith.functions.presence import ladder

# Units in KiB, overhead factors by runtime, least overhead in MiB.
UNIT_KIB = {"K": 1, "M": 1024, "G": 1024**2, "T": 1024**3}
DEFAULT_UNIT = "M"
JVM_RUNTIMES = ("Java", "Scala")
JVM_OVERHEAD_FACTOR = "0.10"
OTHER_OVERHEAD_FACTOR = "0.40"
LEAST_OVERHEAD_MIB = 384

# An integer, then nothing or a unit letter; text after the unit does not
# count, but a second, different unit letter makes the size malformed.
SIZE = r"(?is)^\s*([+-]?[0-9]+)(?:([KMGT])(?!.*(?!\2)[KMGT]).*|\s*)\z"

KIB_TYPE = "decimal(20,0)"
MIB_TYPE = "decimal(20,0)"
FACTOR_TYPE = "decimal(9,4)"


def whole_mib(text: Column) -> Column:
    """Whole MiB of a size text; null where it is absent or malformed.

    The number ends at the first unit letter, no unit means MiB, and KiB are cut
    towards zero. Sizes beyond 64 bits of KiB are malformed.
    """
    number = F.regexp_extract(text, SIZE, 1).try_cast("bigint")
    unit = F.upper(F.regexp_extract(text, SIZE, 2))
    units = {"": UNIT_KIB[DEFAULT_UNIT], **UNIT_KIB}
    factors = F.create_map(*[F.lit(x) for unit_kib in units.items() for x in unit_kib])
    kib = F.try_multiply(number, F.element_at(factors, unit).cast("bigint"))
    exact = kib.cast(KIB_TYPE) / F.lit(UNIT_KIB[DEFAULT_UNIT])
    return exact.cast("bigint")


def size_mib(text: Column) -> Column:
    """``whole_mib``, with 0 for malformed text; absent text stays null."""
    return F.when(text.isNotNull(), F.coalesce(whole_mib(text), F.lit(0).cast("bigint")))


def overhead_mib(
    mib: Column,
    runtime: Column,
    overheads: Sequence[Column] = (),
    factors: Sequence[Column] = (),
) -> Column:
    """Overhead in MiB: the first explicit text of ``overheads``, else the
    larger of the least overhead and factor x ``mib``.

    The factor is the first of ``factors`` that is set, a malformed one counts
    as 0; without any it depends on the runtime.
    """
    by_runtime = F.when(runtime.isin(*JVM_RUNTIMES), F.lit(JVM_OVERHEAD_FACTOR)).otherwise(
        F.lit(OTHER_OVERHEAD_FACTOR)
    )
    factor_text = ladder(list(factors), by_runtime)
    factor = F.coalesce(factor_text.try_cast(FACTOR_TYPE), F.lit(0).cast(FACTOR_TYPE))
    least = F.lit(LEAST_OVERHEAD_MIB).cast(MIB_TYPE)
    computed = F.greatest(least, mib.cast(MIB_TYPE) * factor)
    if not overheads:
        return computed
    explicit = ladder(list(overheads))
    return F.when(explicit.isNotNull(), size_mib(explicit).cast(MIB_TYPE)).otherwise(computed)
