"""Records to rows: prefixed keys, option rows, set columns, lists, sources.

All of these work on single rows, in one pass over the scan; only
``extract_prefixed`` shuffles, to settle clashes, and so does a table of
prefixes, which is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tiersmith.functions.text import last_segment
from tiersmith.operators.joins import split_join
from tiersmith.operators.ordering import row_positions
from tiersmith.operators.prefixes import prefix_matches

# Option rows of a volume and of a secret, by kind.
VOLUME_OPTIONS: dict[str, list[tuple[str, str]]] = {
    "hostPath": [("mount.path", "path"), ("options.path", "host_path"), ("options.type", "host_type")],
    "emptyDir": [("mount.path", "path")],
    "claim": [("mount.path", "path"), ("options.claimName", "claim_name")],
}
SECRET_FILES = {
    "GCPServiceAccount": ("GOOGLE_APPLICATION_CREDENTIALS", "key.json"),
    "HadoopDelegationToken": ("HADOOP_TOKEN_FILE_LOCATION", "hadoop.token"),
}


def prefixed_rows(
    df: DataFrame,
    prefixes: Sequence[str] | DataFrame,
    mode: str = "last_segment",
    key: str = "key",
    longest: bool = False,
) -> DataFrame:
    """(entity, prefix, subkey, value, seq) of all writes whose key contains a
    prefix, one row per prefix, or one for the ``longest`` (ties: the smallest).

    The sub-key is the text after the last dot, or with ``after_prefix`` all
    text after the prefix. A list of prefixes is part of the expression, so a key
    is tested during the scan and no join is needed. A table (prefix) is joined to
    the distinct keys, see ``prefix_matches``, and these to the writes.
    """
    if mode == "last_segment":
        subkey = last_segment(F.col("_key"))
    elif mode == "after_prefix":
        subkey = F.expr("substring(_key, locate(prefix, _key) + char_length(prefix))")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    writes = df.where(F.col("value").isNotNull())
    if isinstance(prefixes, DataFrame):
        named = writes.select("entity", F.col(key).alias("_key"), "value", "seq")
        rows = split_join(named, prefix_matches(named, "_key", prefixes, longest=longest), ["_key"], "inner")
    else:
        wanted = F.array(*[F.lit(p) for p in sorted(set(prefixes), key=lambda p: (-len(p), p))])
        found = F.filter(wanted, lambda p: F.col(key).contains(p))
        found = F.slice(found, 1, 1) if longest else found
        rows = writes.where(_contains_any(F.col(key), prefixes))
        rows = rows.select("entity", F.col(key).alias("_key"), "value", "seq", F.explode(found).alias("prefix"))
    return rows.select("entity", "prefix", subkey.alias("subkey"), "value", "seq")


def extract_prefixed(
    df: DataFrame,
    prefixes: Sequence[str] | DataFrame,
    mode: str = "last_segment",
    key: str = "key",
    longest: bool = False,
) -> DataFrame:
    """(entity, prefix, subkey, value) of the keys that contain a prefix. Where
    two keys give the same sub-key, the write with the largest ``seq`` wins."""
    top = F.max(F.struct("seq", "value")).alias("top")
    settled = prefixed_rows(df, prefixes, mode, key, longest).groupBy("entity", "prefix", "subkey").agg(top)
    return settled.select("entity", "prefix", "subkey", "top.value")


def _contains_any(key: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | key.contains(prefix)
    return found


def unpivot_present(
    df: DataFrame,
    columns: Mapping[str, str],
    flag: str | None = None,
    constants: Mapping[str, str] | None = None,
    entity: str = "entity",
) -> DataFrame:
    """(entity, pos, key, value) for every column that is set.

    ``constants`` come first and only where ``flag`` is on; nothing comes out
    where it is off. A list is set if it has items, and they are joined with
    commas. ``pos`` numbers the emitted rows of a record from 1.
    """
    fixed = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (constants or {}).items()]
    given = [
        F.struct(F.lit(key).alias("key"), _text(df, name).alias("value"))
        for name, key in columns.items()
    ]
    on = df if flag is None else df.where(F.col(flag))
    rows = F.filter(F.array(*fixed, *given), lambda r: r["value"].isNotNull())
    return on.select(F.col(entity), F.posexplode(rows).alias("pos", "row")).select(
        entity, (F.col("pos") + 1).alias("pos"), "row.key", "row.value"
    )


def _text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, ArrayType):
        return F.when(F.size(name) > 0, F.array_join(name, ","))
    return F.col(name).cast("string")


def expand_options(
    df: DataFrame,
    rules: Mapping[str, Sequence[tuple[str, str | Column]]],
    kind: str = "kind",
    keep: Sequence[str] = ("parent", "name"),
) -> DataFrame:
    """One tagged record to the option rows of its kind: (keep.., option, value).

    ``rules`` lists (option, column) by kind; an option without a value is left
    out, a kind without a rule gives no rows.
    """
    rows = None
    for tag, pairs in rules.items():
        options = [
            F.struct(F.lit(option).alias("option"), _column(source).cast("string").alias("value"))
            for option, source in pairs
        ]
        rows = (F if rows is None else rows).when(F.col(kind) == tag, F.array(*options))
    known = df.where(F.col(kind).isin(*rules))
    return known.select(*keep, F.inline(rows)).where(F.col("value").isNotNull())


def _column(source: str | Column) -> Column:
    return source if isinstance(source, Column) else F.col(source)


def secret_rules(
    secret_prefix: str, env_prefix: str, kinds: Sequence[str], name: str = "name", path: str = "path"
) -> dict[str, list[tuple[str, str | Column]]]:
    """``expand_options`` rules for secrets: the mount path for every kind, and
    for the kinds with a known file also the variable that points to it."""
    rules: dict[str, list[tuple[str, str | Column]]] = {}
    for kind in kinds:
        pairs: list[tuple[str, str | Column]] = [(secret_prefix, path)]
        if kind in SECRET_FILES:
            variable, file_name = SECRET_FILES[kind]
            joined = F.concat_ws("/", F.regexp_replace(F.col(path), r"/+\z", ""), F.lit(file_name))
            pairs.append((env_prefix + variable, joined))
        rules[kind] = pairs
    return rules


def explode_list(df: DataFrame, col: str, entity: str = "entity", separator: str = ",") -> DataFrame:
    """(entity, pos, item) of separated text. Empty text gives one empty item, a
    trailing separator a trailing empty item, null gives no rows; no trimming."""
    items = F.split(F.col(col), "\\Q" + separator + "\\E", -1)
    return df.select(entity, F.posexplode(items).alias("pos", "item")).withColumn("pos", F.col("pos") + 1)


def collect_sources(sources: Mapping[str, DataFrame], row_pos: str | None = None) -> DataFrame:
    """Append the rows of several sources and keep duplicates; ``source`` names
    where a row came from and ``source_pos`` gives the order of the sources.

    ``row_pos`` names a further column with the place of a row in its source,
    from 1, see ``row_positions``: ordered by (source_pos, row_pos), the rows
    stand as they do in the sources, one after the other.
    """
    placed = {name: df if row_pos is None else row_positions(df, row_pos) for name, df in sources.items()}
    tagged = [
        df.withColumns({"source": F.lit(name), "source_pos": F.lit(pos)})
        for pos, (name, df) in enumerate(placed.items(), start=1)
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
