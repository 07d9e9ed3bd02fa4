"""Rules kept in a table of prefixes, matched to keys by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.operators.joins import split_join

_PIECE = "_ts_piece"


def prefix_matches(
    rows: DataFrame, key: str, prefixes: DataFrame, anywhere: bool = True, longest: bool = False, prefix: str = "prefix"
) -> DataFrame:
    """(key, prefix): the distinct keys of ``rows`` that contain a prefix, or begin with one unless ``anywhere``.

    A key is cut into its pieces of every length that a prefix has: all of them, or
    those at its start. Hashes of pieces and prefixes are joined and what meets is
    verified, so the work is one row for each piece of a distinct key, whatever the
    number of prefixes, and no key is compared with all of them. A prefix that
    very many keys hold can be split among tasks.

    With ``longest`` a key keeps its longest prefix only, of equally long ones the
    smallest. The empty prefix is in every key. Null keys and prefixes match
    nothing, and repeated ones count once. The lengths in use go to the driver,
    as many numbers as there are different lengths.
    """
    wanted = prefixes.select(F.col(prefix).alias("prefix")).where(F.col("prefix").isNotNull()).distinct()
    lengths = sorted(r["n"] for r in wanted.select(F.length("prefix").alias("n")).distinct().collect())
    names = rows.select(F.col(key).alias(key)).where(F.col(key).isNotNull()).distinct()
    if not lengths:
        return names.select(key, F.lit(None).cast("string").alias("prefix")).where(F.lit(False))
    size = F.length(key)

    def pieces(n: Column) -> Column:
        last = size - n + 1 if anywhere else F.lit(1)
        return F.transform(F.sequence(F.lit(1), last), lambda at: F.xxhash64(F.substring(F.col(key), at, n)))

    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= size)
    cut = names.withColumn(_PIECE, F.explode(F.array_distinct(F.flatten(F.transform(fitting, pieces)))))
    met = split_join(cut, wanted.withColumn(_PIECE, F.xxhash64("prefix")), [_PIECE], "inner").drop(_PIECE)
    held = F.col(key).contains(F.col("prefix")) if anywhere else F.startswith(F.col(key), F.col("prefix"))
    found = met.where(held).select(key, "prefix")
    if not longest:
        return found
    best = F.min(F.struct((-F.length("prefix")).alias("n"), F.col("prefix"))).alias("best")
    return found.groupBy(key).agg(best).select(key, "best.prefix")
