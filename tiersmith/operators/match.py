"""Matching attachments to resources, and ordered lists per parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.operators.joins import interval_join, keyed_join, split_join
from tiersmith.operators.ordering import BUCKET_ROWS, PART_ROWS, hot_groups, number_rows, part_of, running_total
from tiersmith.operators.prefixes import prefix_matches


def match_split(
    mounts: DataFrame, volumes: DataFrame, prefix: str | DataFrame, keys: Sequence[str] = ("parent", "name")
) -> tuple[DataFrame, DataFrame]:
    """Mounts that have a volume whose name starts with ``prefix``, with the
    columns of that volume, and all other mounts.

    Volumes are unique by ``keys``. A mount without the prefix, or without a
    name, cannot match: it takes part in no join and passes without a shuffle.
    Spark broadcasts the volumes if they are small and splits hot keys otherwise.
    A table of prefixes (prefix) is joined to the names of the volumes instead,
    and every mount takes part in the join.
    """
    name = keys[-1]
    if isinstance(prefix, DataFrame):
        special, _ = split_volumes(volumes, prefix, name)
        return split_join(mounts, special, keys, "inner"), split_join(mounts, special.select(*keys), keys, "left_anti")
    special = volumes.where(F.col(name).startswith(prefix))
    likely = F.coalesce(F.col(name).startswith(prefix), F.lit(False))
    matched = split_join(mounts.where(likely), special, keys, "inner")
    unmatched = split_join(mounts.where(likely), special.select(*keys), keys, "left_anti")
    return matched, unmatched.unionByName(mounts.where(~likely))


def split_volumes(volumes: DataFrame, prefix: str | DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Volumes whose name starts with ``prefix``, or with one of a table (prefix), and the others."""
    if isinstance(prefix, DataFrame):
        names = prefix_matches(volumes, name, prefix, anywhere=False).select(name).distinct()
        return tuple(split_join(volumes, names, [name], how) for how in ("left_semi", "left_anti"))
    special = F.coalesce(F.col(name).startswith(prefix), F.lit(False))
    return volumes.where(special), volumes.where(~special)


def attach_matching(
    mounts: DataFrame,
    volumes: DataFrame,
    order: Sequence[str],
    cumulative: bool = True,
    parent_mounts: DataFrame | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Attach to each child the mounts whose (parent, name) has a volume.

    Returns the rows (parent, child, name, path, shared, known, pos) of all
    mounts with a parent. ``known`` rows have a volume and are attached; the others only tell which children
    exist. ``shared`` rows are mounts of the parent itself: they are attached
    unseen, have a null child and come first in the list of every child.

    With ``cumulative`` a child also has the mounts of all children before it.
    ``pos`` then counts the attached rows of a parent in the order of (child,
    ``order``), and the list of a child is 1..pos of its last row. Otherwise
    ``pos`` counts within the child, and its list is the shared rows and then
    its own. Either way a mount is stored once, where writing out the running
    lists would grow with the square of the children.
    """
    place = ["child", *[c for c in order if c != "child"]]
    rows = mounts.where(F.col("parent").isNotNull())
    rows = rows.select("parent", *place, "name", "path").withColumn("shared", F.lit(False))
    existing = volumes.select("parent", "name").distinct().withColumn("known", F.lit(True))
    tagged = split_join(rows, existing, ["parent", "name"], "left").fillna(False, ["known"])
    sizing = rows
    if parent_mounts is not None:
        own = parent_mounts.where(F.col("parent").isNotNull()).withColumns(
            {"child": F.lit(None).cast(mounts.schema["child"].dataType), "shared": F.lit(True), "known": F.lit(True)}
        )
        tagged = tagged.unionByName(own, allowMissingColumns=True)
        sizing = sizing.unionByName(own.drop("known"), allowMissingColumns=True)
    # A null child sorts first, so shared rows come before all children.
    group = ["parent"] if cumulative else ["parent", "child"]
    hot = hot_groups(sizing, group, bucket_rows)
    placed = running_total(tagged, group, place, F.col("known").cast("int"), "pos", hot)
    return placed.select("parent", "child", "name", "path", "shared", "known", "pos")


def attached_children(placed: DataFrame) -> DataFrame:
    """Children of ``attach_matching``, with or without a match: (parent, child,
    n_own, last_pos). With ``cumulative`` the list of a child has ``last_pos``
    mounts."""
    return (
        placed.where(~F.col("shared"))
        .groupBy("parent", "child")
        .agg(F.count_if("known").alias("n_own"), F.max("pos").alias("last_pos"))
    )


def attached_items(placed: DataFrame, children: DataFrame | None = None, cumulative: bool = True) -> DataFrame:
    """Lists of the children of ``attach_matching``, written out: (parent, child, pos, name, path).

    ``children`` has the rows of ``attached_children`` whose lists are wanted, by
    default all. ``cumulative`` is what ``attach_matching`` was told; the lists
    of a parent then grow with the square of its children, and asking for some
    children writes only theirs. ``pos`` counts a list from 1. A child without a
    match has no row here, see ``attached_lists``.

    A running list is a span 1..last_pos of its parent's positions, so this is one
    interval join. Without ``cumulative`` only the mounts of the parent itself
    are a span; the own mounts of a child are its rows already.
    """
    known = placed.where(F.col("known"))
    children = attached_children(placed) if children is None else children
    columns = ["parent", "child", "pos", "name", "path"]
    if cumulative:
        items = known.select("parent", "pos", "name", "path")
        return interval_join(items, children.select("parent", "child", "last_pos"), ["parent"]).select(*columns)
    shared = known.where(F.col("shared")).select("parent", "pos", "name", "path")
    head = shared.groupBy("parent").agg(F.max("pos").alias("_ts_head"))
    wanted = children.select("parent", "child")
    spans = split_join(wanted, head, ["parent"], "inner")
    own = known.where(~F.col("shared")).select(*columns)
    own = split_join(own, wanted, ["parent", "child"], "left_semi", null_safe=True)
    own = split_join(own, head, ["parent"], "left").withColumn("pos", F.col("pos") + F.coalesce("_ts_head", F.lit(0)))
    return interval_join(shared, spans, ["parent"], last="_ts_head").select(*columns).unionByName(own.select(*columns))


def attached_lists(
    placed: DataFrame, children: DataFrame | None = None, cumulative: bool = True, part_rows: int = PART_ROWS
) -> DataFrame:
    """The lists of ``attached_items`` as arrays: (parent, child, part, n_items, mounts), ``mounts`` being structs of
    (name, path) in order. A part holds ``part_rows`` mounts; a child without a match has one empty part.

    With ``cumulative`` a part of a child is the same part of its parent, cut at ``last_pos``. So the mounts are gathered
    once for each parent, and a child meets arrays: what is shuffled grows with the mounts and the parts of the lists,
    not with their items.
    """
    children = attached_children(placed) if children is None else children
    if cumulative:
        known = placed.where(F.col("known"))
        blocks = _gathered(known.select("parent", "pos", "name", "path"), ["parent"], part_rows)
        final = F.greatest(part_of(F.col("last_pos"), part_rows), F.lit(0))
        wide = children.select("parent", "child", "last_pos", F.explode(F.sequence(F.lit(0), final)).alias("part"))
        joined = split_join(wide, blocks, ["parent", "part"], "left")
        joined = joined.where((F.col("part") == 0) | F.col("mounts").isNotNull())  # as far as the parent has mounts
        room = F.col("last_pos") - F.col("part").cast("bigint") * part_rows
        joined = joined.withColumn("mounts", F.slice("mounts", F.lit(1), F.least(room, F.lit(part_rows)).cast("int")))
    else:
        blocks = _gathered(attached_items(placed, children, cumulative), ["parent", "child"], part_rows)
        joined = keyed_join(children.select("parent", "child"), blocks, ["parent", "child"], "left")
    mounts = F.coalesce("mounts", F.array().cast(blocks.schema["mounts"].dataType))
    return joined.select("parent", "child", F.coalesce("part", F.lit(0)).alias("part"), F.size(mounts).alias("n_items"), mounts.alias("mounts"))


def _gathered(items: DataFrame, keys: Sequence[str], part_rows: int) -> DataFrame:
    """(keys, part, mounts): the (name, path) of each part of ``part_rows`` positions, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name", "path")))
    mounts = F.transform(ordered, lambda i: F.struct(i["name"], i["path"]))
    return items.withColumn("part", part_of(F.col("pos"), part_rows)).groupBy(*keys, "part").agg(mounts.alias("mounts"))


def number_and_join(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    prefix: str,
    entity: str = "entity",
    part_rows: int = PART_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    sizing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Number the rows of an entity 1..n in order and name the slots
    ``<prefix>n``; returns the rows and the comma-joined lists.

    Duplicates stay and there is no trailing comma. A list holds ``part_rows``
    values: those from part * part_rows + 1 on. For ``sizing`` see ``number_rows``.
    """
    rows = number_rows(df, [entity], order, "pos", bucket_rows, sizing)
    rows = rows.withColumn("slot", F.concat(F.lit(prefix), F.col("pos").cast("string")))
    part = part_of(F.col("pos"), part_rows)
    items = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).cast("string").alias("item"))))
    lists = (
        rows.withColumn("part", part)
        .groupBy(entity, "part")
        .agg(F.count("*").alias("n_items"), F.array_join(F.transform(items, lambda i: i["item"]), ",").alias("list"))
    )
    return rows, lists


def select_named_or_all(
    df: DataFrame, target: str | None, parent: str = "parent", pos: str = "pos", name: str = "name"
) -> DataFrame:
    """Keep only the child called ``target``, the first if there are several;
    parents without one, or all if no target is given, keep all children.

    Only the rows with the name are aggregated, and the result has at most one
    row per parent.
    """
    if not target:
        return df
    first = df.where(F.col(name) == target).groupBy(parent).agg(F.min(pos).alias("_first"))
    joined = split_join(df, first, [parent], "left")
    return joined.where(F.col("_first").isNull() | (F.col(pos) == F.col("_first"))).drop("_first")
