"""Which write, which layer supplies a setting?

All tables are long: one row per write of a setting, with the columns
``entity``, ``key``, ``value``, ``layer`` and a ``seq`` that orders the writes.
A null value is not a write unless a presence rule says so. A null entity is an
entity like any other; a null key is no key, and its rows are left out.

Latest write, first layer and merged layers are all "the row with the greatest
priority per (entity, key)": one aggregate that combines before its shuffle, so
an entity or a key with very many writes costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.functions.presence import is_present
from tiersmith.operators.joins import split_join
from tiersmith.operators.ordering import BUCKET_ROWS, PART_ROWS, number_rows, part_of

LayerOrder = Sequence[str] | DataFrame

CONSTANT_LAYER = "constant"  # what the result calls the defaults; rows of defaults are told by a flag
LOWEST_PRIORITY = -(2**31)


def _winner(df: DataFrame, keys: Sequence[str], priority: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """Per ``keys`` the ``carry`` columns of the row with the greatest priority.

    Equal priorities are told apart by the carried values, so the result does
    not depend on the order in which rows arrive.
    """
    ranked = [p.alias(f"_p{i}") for i, p in enumerate(priority)]
    top = F.max(F.struct(*ranked, *carry)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in carry])


def with_rank(df: DataFrame, layer_order: LayerOrder, layer: str = "layer", out: str = "layer_rank") -> DataFrame:
    """Add the rank of a layer (lower wins) and drop rows of unknown layers.

    A list becomes part of the expression and needs no join. A table of
    (layer, layer_rank) is joined; Spark broadcasts it if it is small.
    """
    if isinstance(layer_order, DataFrame):
        ranks = layer_order.select(F.col("layer").alias(layer), F.col("layer_rank").cast("int").alias(out))
        return df.join(ranks, layer, "inner")
    names = F.array(*[F.lit(name) for name in layer_order])
    return df.withColumn(out, F.array_position(names, F.col(layer)).cast("int")).where(F.col(out) > 0)


def latest_setting(
    df: DataFrame, entity: str = "entity", key: str = "key", value: str = "value", seq: str = "seq"
) -> DataFrame:
    """Last write of each (entity, key). Null is not a write, empty text is."""
    writes = df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    return _winner(writes, [entity, key], [F.col(seq)], [value])


def resolve_layers(
    df: DataFrame,
    layer_order: LayerOrder,
    entities: DataFrame,
    defaults: Mapping[str, str | None],
    presence: str = "non_empty",
) -> DataFrame:
    """(entity, key, value, layer) for every entity and default key.

    A layer holds its latest write of a key. The first layer whose write is
    present under the rule supplies the value; the constant default does where
    no layer can. Null is not a write, except under ``key_exists``.

    The defaults take part as one more layer below all others, so settings are
    not joined with entities. Layers given as a list are resolved by a single
    aggregate, a table of layers by one per step.
    """
    asked = df.where(F.col("key").isin(*defaults))
    if presence != "key_exists":
        asked = asked.where(F.col("value").isNotNull())
    writes = asked.select("entity", "key", "seq", "value", "layer", F.lit(False).alias("is_default"))
    constants = entities.select("entity", F.inline(_constant_rows(defaults.items()))).withColumns(
        {"seq": F.lit(None).cast(df.schema["seq"].dataType), "layer": F.lit(CONSTANT_LAYER), "is_default": F.lit(True)}
    )
    if isinstance(layer_order, DataFrame):
        return _resolve_by_table(writes, layer_order, constants, presence)

    write = F.struct("seq", "value")
    latest = [F.max(F.when((F.col("layer") == name) & ~F.col("is_default"), write)) for name in layer_order]
    grouped = (
        writes.where(F.col("layer").isin(*layer_order))
        .unionByName(constants)
        .groupBy("entity", "key")
        .agg(*[w.alias(f"write_{i}") for i, w in enumerate(latest)], F.max(F.when(F.col("is_default"), write)).alias("default"))
        .where(F.col("default").isNotNull())
    )
    supplied = []
    for i, name in enumerate(layer_order):
        value = F.col(f"write_{i}.value")
        given = F.col(f"write_{i}").isNotNull() & is_present(value, presence)
        supplied.append(F.when(given, F.struct(value.alias("value"), F.lit(name).alias("layer"))))
    supplied.append(F.struct(F.col("default.value").alias("value"), F.lit(CONSTANT_LAYER).alias("layer")))
    return grouped.select("entity", "key", F.coalesce(*supplied).alias("top")).select(
        "entity", "key", "top.value", "top.layer"
    )


def _constant_rows(pairs: Iterable[tuple[str, str | None]]) -> Column:
    """Array of (key, value) rows that are part of the expression."""
    return F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for k, v in pairs]
    )


def _resolve_by_table(writes: DataFrame, layer_order: DataFrame, constants: DataFrame, presence: str) -> DataFrame:
    effective = _winner(
        with_rank(writes, layer_order), ["entity", "key", "layer", "layer_rank"], [F.col("seq")], ["value"]
    )
    present = effective.where(is_present(F.col("value"), presence)).withColumn("is_default", F.lit(False))
    rows = present.withColumn("priority", -F.col("layer_rank")).drop("layer_rank").unionByName(
        constants.drop("seq").withColumn("priority", F.lit(LOWEST_PRIORITY))
    )
    top = F.max(F.struct(~F.col("is_default"), "priority", "value", "layer")).alias("top")
    wanted = F.bool_or("is_default").alias("wanted")
    return rows.groupBy("entity", "key").agg(top, wanted).where("wanted").select("entity", "key", "top.value", "top.layer")


def layer_usage(resolved: DataFrame) -> DataFrame:
    """Number of entities that take a key from a layer."""
    return resolved.groupBy("key", "layer").agg(F.count("*").alias("n_entities"))


def merge_layers(df: DataFrame, order: LayerOrder) -> DataFrame:
    """Key by key merge in long form: the later layer of ``order`` wins, within
    a layer the latest write."""
    writes = with_rank(df.where(F.col("value").isNotNull() & F.col("key").isNotNull()), order)
    return _winner(writes, ["entity", "key"], [F.col("layer_rank"), F.col("seq")], ["value", "layer"])


def merge_layer_maps(
    df: DataFrame, order: LayerOrder, part_keys: int = PART_ROWS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``merge_layers`` as maps with sorted keys: (entity, part, n_keys, settings).

    A map holds ``part_keys`` keys of an entity in their order: those from
    part * part_keys + 1 on. ``df`` has at least as many rows of an entity as it
    has keys, so it tells which entities are too large for one window.
    """
    numbered = number_rows(merge_layers(df, order), ["entity"], ["key"], "pos", bucket_rows, df)
    merged = numbered.withColumn("part", part_of(F.col("pos"), part_keys))
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return merged.groupBy("entity", "part").agg(
        F.count("*").alias("n_keys"), F.map_from_entries(entries).alias("settings")
    )


def first_nonempty_layer(
    df: DataFrame,
    layer_order: LayerOrder,
    entities: DataFrame,
    default_rows: Sequence[tuple[str, str]],
    presence: str = "not_null",
) -> DataFrame:
    """The first layer with any row for an entity supplies all its rows; an
    entity without rows gets ``default_rows``. Returns (entity, key, value,
    layer, seq). A null entity is one entity, here too.

    The deciding rank is an aggregate of one row per entity. Rows are joined to
    it, so that Spark can split a hot entity, where a window would hold all its
    rows in one task.
    """
    rows = with_rank(df.where(is_present(F.col("value"), presence)), layer_order)
    rows = rows.select("entity", "key", "value", "layer", "seq", "layer_rank")
    first = rows.groupBy("entity").agg(F.min("layer_rank").alias("layer_rank"))
    supplied = split_join(rows, first, ["entity", "layer_rank"], "left_semi", null_safe=True)
    # Asking for the rank here too lets both joins share one shuffle.
    ranked = first.where(F.col("layer_rank").isNotNull()).select(F.col("entity").alias("_ranked"))
    fallback = (
        entities.select("entity")
        .join(ranked, F.col("entity").eqNullSafe(F.col("_ranked")), "left_anti")
        .select("entity", F.inline(_constant_rows(default_rows)))
        .withColumns(
            {
                "layer": F.lit(CONSTANT_LAYER),
                "seq": F.lit(None).cast(df.schema["seq"].dataType),
            }
        )
    )
    return supplied.select("entity", "key", "value", "layer", "seq").unionByName(fallback)
