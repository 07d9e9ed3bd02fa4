"""The flows that the operators serve, from settings to their result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.operators import (
    collect_sources,
    explode_list,
    first_nonempty_layer,
    latest_setting,
    layer_usage,
    merge_layers,
    normalise_codes,
    number_and_join,
    parse_or_quarantine,
    prefixed_rows,
    render_documents,
    resolve_layers,
    unpivot_present,
)

from tiersmith.operators.ordering import PART_ROWS

# Layer of the settings that come from prefixed keys.
PREFIXED = "prefixed"


def layer_report(
    log: DataFrame, layer_order: Sequence[str], entities: DataFrame, defaults: Mapping[str, str]
) -> DataFrame:
    """How many entities take each key from each layer."""
    return layer_usage(resolve_layers(log, layer_order, entities, defaults, "non_empty"))


def service_labels(log: DataFrame, order: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Labels of an entity: those of its layers merged in ``order``, overridden
    by labels given through prefixed keys."""
    prefixed = prefixed_rows(log, prefixes, key="conf_key").withColumnRenamed("subkey", "key")
    columns = ["entity", "key", "value", "seq", "layer"]
    layers = log.select(*columns).unionByName(prefixed.withColumn("layer", F.lit(PREFIXED)).select(*columns))
    return merge_layers(layers, [*order, PREFIXED]).select("entity", "key", "value")


def local_directories(
    mounts: DataFrame,
    order: Sequence[str],
    lists: Mapping[str, DataFrame],
    entities: DataFrame,
    prefix: str,
    default: str,
    slot: str,
    part_rows: int = PART_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Scratch directories of an entity: its mounts whose name contains
    ``prefix``, or else the items of its first list, or else ``default``.

    ``mounts`` has (entity, name, path) and the columns ``order``, every list
    (entity, text) by name in order of preference. Mounts and items are ordered
    by one struct column, so that only the rows that are supplied are numbered,
    by one window. Returns the numbered slots and the joined lists.
    """
    kinds = {c: mounts.schema[c].dataType for c in order}
    of_mount = F.struct(*[F.col(c) for c in order], F.lit(0).alias("_item"))
    named = mounts.where(F.col("name").contains(prefix)).select(
        "entity", "name", F.col("path").alias("value"), of_mount.alias("seq")
    )
    sources = {"mounts": named}
    for name, texts in lists.items():
        of_item = F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in order], F.col("pos").alias("_item"))
        sources[name] = explode_list(texts, "text").select(
            "entity", F.lit("").alias("name"), F.col("item").alias("value"), of_item.alias("seq")
        )
    rows = collect_sources(sources).withColumnsRenamed({"source": "layer", "name": "key"})
    supplied = first_nonempty_layer(rows, list(sources), entities, [("", default)])
    return number_and_join(supplied, "value", ["seq"], slot, part_rows=part_rows, sizing=rows)


def settings_documents(
    log: DataFrame,
    entities: DataFrame,
    layer_order: Sequence[str],
    defaults: Mapping[str, str],
    default_port: int,
    escape_keys: Sequence[str] = (),
) -> DataFrame:
    """One property document per entity: its identity, and its resolved settings,
    which win where they write the same key."""
    ports, _ = parse_or_quarantine(entities, "port_text", default_port, "default", "port")
    known = normalise_codes(ports, "code", out="runtime")
    identity = unpivot_present(known, {"name": "app.name", "runtime": "app.runtime", "port": "app.port"})
    resolved = resolve_layers(log, layer_order, entities, defaults, "not_null")
    rows = collect_sources(
        {"identity": identity.select("entity", "key", "value"), "settings": resolved.select("entity", "key", "value")}
    )
    # Three lines of identity and the default keys, once each: no entity has more.
    limit = 3 + len(defaults)
    return render_documents(latest_setting(rows, seq="source_pos"), escape_keys, group_limit=limit)
