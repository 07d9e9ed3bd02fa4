"""Mixing sources to target weights, dealt to output shards by a splitting tree.

The rows of a source are put in a random but repeatable order by a keyed hash,
and cut into blocks of about equal words along it. A source whose target is
above its size is taken whole once or twice, and the rest of its target is a
prefix of that order. What is taken are units (source, pass, block). Their
numbers are split over the shards by a binary tree: each node halves its vector
of units by source with a multivariate hypergeometric draw, so that every shard
gets an exact quota and any shard is a fair sample of the mix. Along a random
order of its units each source then hands disjoint runs to the shards, and a
shard shuffles its rows locally.

Everything random is a function of the seed and of the rows, so a rerun agrees.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, plain_names, prepare

WORDS = r"[^\x20\x09-\x0D]+"
#: Words of a block and of a shard; a small mix has smaller ones, so that it fills LEAST_SHARDS shards with SHARD_BLOCKS blocks each.
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 16_000_000
LEAST_SHARDS = 8
SHARD_BLOCKS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with idx, weight and target.

    Sources are numbered by code point, null last, and weigh ``weights`` in
    turn. They share ``share`` times all sizes by weight; a target stops at
    ``most`` times its source's size, and what it leaves is shared among the
    others by weight. That is one level for all: target = min(most * size, level * weight).
    """
    ordered = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*")).collect())  # one row for each partition
    before, total = [], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(total)]
        total += n
    idx = F.col("_at").bitwiseAND((1 << 33) - 1)
    numbered = ordered.withColumn("idx", (idx + F.create_map(*before)[part]) if before else idx).drop("_at")
    numbered = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    words = ordered.agg(F.sum("source_size")).first()[0] or 0
    level, goal = 0.0, share * words
    while words:
        fair = F.lit(level) * F.col("weight")
        kept, free = numbered.agg(F.sum(F.when(cap < fair, cap)), F.sum(F.when(~(cap < fair), F.col("weight")))).first()
        if free is None:
            break
        new = (goal - (kept or 0.0)) / free
        if new <= level:
            break
        level = new
    return numbered.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def split_quotas(units: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, idx, quota) from (idx, quota): 2**levels shards whose totals differ by one at most.

    Level by level; a node's vector has one number for each source that has units there.
    """
    nodes = units.select(F.lit(0).cast("long").alias("node"), F.col("idx").cast("long"), F.col("quota").cast("long"))
    for level in range(levels):
        nodes = nodes.groupBy("node").applyInPandas(_halving(seed, level), "node long, idx long, quota long")
    return nodes.withColumnRenamed("node", "shard")


def _fitting(rows: pd.DataFrame) -> pd.DataFrame:
    """Keys, in order, of the rows that still fit into the room that earlier ones
    leave, and the smallest other row if the room is nearer with it."""
    rows = rows.sort_values("_key")
    room, taken, left = float(rows["room"].iloc[0]), [], []
    for key, size in zip(rows["_key"], rows["size"], strict=True):
        if size <= room:
            room -= size
            taken.append(key)
        else:
            left.append((size, key))
    if left and min(left)[0] < 2 * room:
        taken.append(min(left)[1])
    return pd.DataFrame({"idx": rows["idx"].iloc[0], "_key": taken})


def _halving(seed: int, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def halve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node = int(key[0])
        rows = rows.sort_values("idx")
        quota = rows["quota"].to_numpy()
        rng = np.random.default_rng([seed, level, node])
        left = rng.multivariate_hypergeometric(quota, int(quota.sum()) // 2, method="marginals")
        both = pd.concat([rows.assign(node=2 * node, quota=left), rows.assign(node=2 * node + 1, quota=quota - left)])
        return both[both["quota"] > 0]

    return halve


def mix(
    df: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    source: str = "source",
    text: str = "text",
    row_id: str = "doc_id",
    seed: int = 17,
    block_words: int | None = None,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``df`` with size, source_size, target and ``shards``, the shard of each copy that the mix takes.

    A row is taken whole: not at all, or once for each entry of ``shards``, at
    most ``ceil(most)`` times. A source's taken words miss its target by half of
    the smallest row at most that is left in the block in which its last pass
    ends; rows that are equal in source, id and text stay together, so a source
    whose size is in copies of one row can miss its target by half of those
    copies. A null text has size 0; a null source is a source of its own; rows of
    size 0 are taken like others. An empty table gives an empty table. The new
    columns replace columns of their names; no other name matters.
    """
    prepare(df.sparkSession)
    base, names = plain_names(df)
    source, text, row_id = names[source], names[text], names[row_id]
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row_id).cast("string"), F.xxhash64(F.col(text))), 1)
    keyed = base.withColumn("_key", key).withColumn("size", word_count(F.col(text)))
    slim = cut(keyed.select(F.col(source).alias("source"), "_key", "size"))  # all but the texts: it is read three times
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    # passes: how often a source is taken whole; rest: words of its last, partial pass
    targets = source_targets(sources, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    targets = cut(targets)
    goal = targets.agg(F.sum("target")).first()[0] or 0
    levels = int(np.ceil(np.log2(max(LEAST_SHARDS, goal / shard_words))))
    if block_words is None:
        block_words = int(min(BLOCK_WORDS, max(1, goal / (SHARD_BLOCKS << levels))))
    targets = targets.withColumn("blocks", F.ceil((F.col("source_size") + 1) / block_words))

    block = F.shiftright(F.shiftright("_key", 32) * F.col("blocks"), 31)
    placed = slim.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("t.idx", "_key", "size", "rest", "passes", block.alias("block"))
    blocks = placed.groupBy("idx", "block", "rest", "passes").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("idx").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(blocks.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))))
    # the one block of a source in which its rest ends, and the rows of it that still fit
    last = blocks.where("before < rest and before + words >= rest").groupBy("idx").agg(F.min_by(F.struct("block", "before"), "block").alias("b"))
    last = cut(last.select(F.col("idx").alias("i"), F.col("b.block").alias("bl"), F.col("b.before").alias("at")))
    inside = placed.where("size > 0").join(last, (F.col("idx") == F.col("i")) & (F.col("block") == F.col("bl")))
    inside = inside.groupBy("idx", "_key", (F.col("rest") - F.col("at")).alias("room")).agg(F.sum("size").alias("size"))
    fits = cut(inside.groupBy("idx").applyInPandas(_fitting, "idx long, _key long"))

    # units: a block in each full pass, and in the partial pass the blocks up to the last one
    ended = blocks.join(last, F.col("idx") == F.col("i"), "left")
    n_units = F.col("passes") + F.when(F.col("block") <= F.col("bl"), 1).otherwise(0)
    units = cut(ended.where(n_units > 0).select("idx", "block", F.explode(F.sequence(F.lit(1), n_units)).alias("pass")))
    quotas = split_quotas(units.groupBy("idx").agg(F.count("*").alias("quota")), levels, seed)
    runs = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotas = quotas.withColumn("upto", F.sum("quota").over(runs))
    drawn = Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed + 1), "idx", "block", "pass"), "block", "pass")
    ranked = units.withColumn("rank", F.row_number().over(drawn) - 1)
    # A shard's run begins at a mark among the units; each unit takes the last mark before it.
    marks = quotas.select("idx", (F.col("upto") - F.col("quota")).alias("rank"), F.col("shard").cast("int").alias("shard"))
    order = Window.partitionBy("idx").orderBy("rank", F.col("block").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = ranked.unionByName(marks, allowMissingColumns=True).withColumn("shard", F.last("shard", ignorenulls=True).over(order)).where("block is not null")
    dealt = dealt.groupBy(F.col("idx").alias("_idx"), F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("_units"))

    ends = targets.join(last.select("i", "bl"), F.col("idx") == F.col("i"), "left")
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in ("source", "idx", "passes", "bl", "blocks", "source_size", "target")])
    fits = fits.select(F.col("idx").alias("_f"), F.col("_key").alias("_fit"))
    out = keyed.join(ends, F.col(f"`{source}`").eqNullSafe(F.col("_source")))
    out = out.withColumn("_b", F.shiftright(F.shiftright("_key", 32) * F.col("_blocks"), 31))
    out = out.join(dealt.withColumnRenamed("_idx", "_d"), (F.col("_idx") == F.col("_d")) & (F.col("_b") == F.col("_block")), "left")
    out = out.join(fits, (F.col("_idx") == F.col("_f")) & (F.col("_key") == F.col("_fit")), "left")
    in_rest = F.coalesce((F.col("_b") < F.col("_bl")) | F.col("_fit").isNotNull(), F.lit(False))
    copies = F.col("_passes") + F.when(in_rest, 1).otherwise(0)
    shards = F.when(copies > 0, F.transform(F.slice("_units", F.lit(1), copies), lambda u: u["shard"])).otherwise(F.array().cast("array<int>"))
    own = [F.col(c).alias(name) for name, c in names.items() if name not in ("size", "source_size", "target", "shards")]
    return out.select(*own, "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), shards.alias("shards"))


def _copies(mixed: DataFrame, seed: int, row_id: str) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """One row for each copy (shard, copy, and the columns of ``mixed`` by number), and the order of the local shuffle."""
    rows, names = plain_names(mixed)
    shards = names.pop("shards")
    rows = rows.where(F.size(shards) > 0).select(*names.values(), F.posexplode(shards).alias("copy", "shard"))
    order = [F.xxhash64(F.lit(seed + 2), F.col(names[row_id]).cast("string"), "copy"), F.col(names[row_id]), F.col("copy")]
    return rows, order, names


def deal(mixed: DataFrame, seed: int = 17, row_id: str = "doc_id") -> DataFrame:
    """One row for each copy that the mix takes, with ``copy``, ``shard`` and ``position``, its place after the local
    shuffle. These replace columns of their names; no other name matters. Rows equal in id and copy are in any order."""
    rows, order, names = _copies(mixed, seed, row_id)
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*order)) - 1
    own = [F.col(c).alias(name) for name, c in names.items() if name not in ("copy", "shard", "position")]
    return rows.withColumn("position", place).select(*own, "copy", "shard", "position")


def shuffled(mixed: DataFrame, seed: int = 17, row_id: str = "doc_id") -> DataFrame:
    """The copies that the mix takes, without the columns of the mix: the rows of a shard stand together, in the order of
    the local shuffle, so that files written from it hold whole shards. One shuffle moves them."""
    rows, order, names = _copies(mixed, seed, row_id)
    rows = rows.repartition("shard").sortWithinPartitions("shard", *order)
    return rows.select(*[F.col(c).alias(name) for name, c in names.items() if name not in ("size", "source_size", "target")])
