"""Property documents: render settings as text, load text as settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.functions.text import escape_key, escape_lead, escape_value, strip_newlines, unescape
from tiersmith.operators.ordering import BUCKET_ROWS, PART_ROWS, number_rows, part_of

# Comment marks, and the key of a line up to its first separator.
# Plain runs are taken whole, so that lines of any length can be matched.
COMMENT = r"^[ \t\f]*+[#!]"
KEY = r"^[ \t\f]*+([^\\=: \t\f]*+(?:\\.[^\\=: \t\f]*+)*+)"
SEPARATOR = KEY + r"[ \t\f]*+[=:]?[ \t\f]*+"
BREAK = r"[\r\n]"

BREAK_POLICIES = ("fail", "strip", "quarantine")


def _has_break(key: str, value: str, strip_keys: Sequence[str]) -> Column:
    """Whether a key, or a value from which breaks are not stripped, holds a line break."""
    in_value = F.col(value).rlike(BREAK)
    if strip_keys:
        in_value = in_value & ~F.col(key).isin(*strip_keys)
    return F.col(key).rlike(BREAK) | F.coalesce(in_value, F.lit(False))


def broken_rows(df: DataFrame, strip_keys: Sequence[str] = (), key: str = "key", value: str = "value") -> DataFrame:
    """Rows that ``render_documents`` leaves out under the policy ``quarantine``."""
    return df.where(F.col(key).isNotNull() & _has_break(key, value, strip_keys))


def render_documents(
    df: DataFrame,
    escape_keys: Sequence[str] = (),
    strip_keys: Sequence[str] = (),
    exact: bool = True,
    entity: str = "entity",
    key: str = "key",
    value: str = "value",
    part_lines: int = PART_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    sizing: DataFrame | None = None,
    on_break: str = "fail",
    group_limit: int | None = None,
) -> DataFrame:
    """Ordered property texts: (entity, part, n_lines, document).

    ``df`` has a key of an entity once; a null key is no key, a null value
    writes an empty text. ``:`` and ``=`` are escaped in the values of
    ``escape_keys``. With ``exact`` all keys, backslashes and leading blanks are
    escaped too, so that loading gives the same keys and values.

    Line breaks are removed from the values of ``strip_keys``. Elsewhere they
    stop the job (``fail``), are removed (``strip``), or their rows are left out
    (``quarantine``), see ``broken_rows``.

    A document holds ``part_lines`` lines of an entity in the order of their
    keys, those from part * part_lines + 1 on; its parts are put one after the
    other. Where ``df`` is costly to compute, ``sizing`` names a cheaper table
    with at least its rows, in which to look for large entities, or
    ``group_limit`` says how many keys an entity has at most.
    """
    if on_break not in BREAK_POLICIES:
        raise ValueError(f"unknown policy {on_break!r}, expected one of {BREAK_POLICIES}")
    rows = df.where(F.col(key).isNotNull())
    name, text = F.col(key), F.coalesce(F.col(value), F.lit(""))
    broken = _has_break(key, value, strip_keys)
    if on_break == "quarantine":
        rows = rows.where(~broken)
    elif on_break == "strip":
        name, text = strip_newlines(name), strip_newlines(text)
    if strip_keys:
        text = F.when(F.col(key).isin(*strip_keys), strip_newlines(text)).otherwise(text)
    plain = escape_lead(F.replace(text, F.lit("\\"), F.lit("\\\\"))) if exact else text
    if escape_keys:
        marked = escape_lead(escape_value(text)) if exact else escape_value(text, False)
        plain = F.when(F.col(key).isin(*escape_keys), marked).otherwise(plain)
    if on_break == "fail":
        message = F.concat(F.lit("line break in the key or value of "), F.col(key))
        plain = F.when(broken, F.raise_error(message).cast("string")).otherwise(plain)
    line = F.concat(escape_key(name) if exact else name, F.lit("="), plain, F.lit("\n"))
    lines = rows.select(F.col(entity), F.col(key), line.alias("line"))

    numbered = number_rows(lines, [entity], [key, "line"], "pos", bucket_rows, df if sizing is None else sizing, group_limit)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return (
        numbered.withColumn("part", part_of(F.col("pos"), part_lines))
        .groupBy(entity, "part")
        .agg(F.count("*").alias("n_lines"), ordered.alias("lines"))
        .select(
            entity, "part", "n_lines", F.array_join(F.transform("lines", lambda r: r["line"]), "").alias("document")
        )
    )


def load_documents(lines: DataFrame, line: str = "line") -> DataFrame:
    """Replace property lines by ``key`` and ``value``; all other columns stay.

    Blank and comment lines are dropped. A line is split at its first unescaped
    separator (``=``, ``:`` or blanks) and both sides are unescaped; a line
    without a separator is a key with an empty value.
    """
    text = F.col(line)
    kept = lines.where(text.rlike(r"\S") & ~text.rlike(COMMENT))
    raw = kept.withColumns({"key": F.regexp_extract(text, KEY, 1), "value": F.regexp_replace(text, SEPARATOR, "")})
    return raw.withColumns({"key": unescape(F.col("key")), "value": unescape(F.col("value"))}).drop(line)


def document_lines(documents: DataFrame, entity: str = "entity") -> DataFrame:
    """Lines of rendered documents: (entity, part, line_no, line)."""
    bare = F.regexp_replace("document", r"\n\z", "")
    return documents.select(
        entity, "part", F.posexplode(F.split(bare, "\n", -1)).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no") + 1)
