"""Text steps: property escapes, key segments and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators that a property value escapes.
ESCAPED_SEPARATORS = (":", "=")

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/?#]*)?+)?+"


def escape_value(value: Column, backslash: bool = True) -> Column:
    """Put a backslash before ``:`` and ``=``, and before backslashes first."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\")) if backslash else value
    for mark in ESCAPED_SEPARATORS:
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def escape_key(key: Column) -> Column:
    """Put a backslash before what would end a key or make its line a comment."""
    marked = F.regexp_replace(key, r"([\\=: \t\f])", r"\\$1")
    return F.regexp_replace(marked, "^([#!])", r"\\$1")


def escape_lead(value: Column) -> Column:
    """Put a backslash before a leading blank, which would else belong to the separator."""
    return F.regexp_replace(value, r"^([ \t\f])", r"\\$1")


# Runs of escaped UTF-16 units (pairs of surrogates, or one unit that is none), other escapes, and plain text.
UNIT = r"\\u(?:[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|(?![dD][89a-fA-F])[0-9a-fA-F]{4})"
TOKENS = rf"(?s)((?:{UNIT})+|\\.|[^\\]+|\\\z)"


def unescape(text: Column) -> Column:
    """Undo property escapes: line, tab and unicode escapes, and a backslash
    before any other character stands for that character. A backslash at the end
    stands for itself."""

    def plain(token: Column) -> Column:
        units = F.unhex(F.replace(token, F.lit("\\u"), F.lit("")))
        out = F.when(token.rlike(f"^{UNIT}"), F.decode(units, "UTF-16BE")).when(token == "\\", token)
        for letter, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("f", "\f")):
            out = out.when(token == "\\" + letter, F.lit(char))
        return out.when(token.startswith("\\"), F.substring(token, 2, 1)).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1))
    return F.when(text.contains("\\"), F.array_join(F.transform(tokens, plain), "")).otherwise(text)


def strip_newlines(value: Column) -> Column:
    """Remove line breaks."""
    return F.replace(F.replace(value, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))


def last_segment(key: Column, separator: str = ".") -> Column:
    """Text after the last separator."""
    return F.substring_index(key, separator, -1)


def location_scheme(location: Column) -> Column:
    """Lower-case URI scheme, empty where there is none."""
    return F.lower(F.regexp_extract(location, SCHEME, 1))


def base_name(location: Column) -> Column:
    """Last element of the path of a location, without query and fragment.

    A location without a path gives ``.``, a path of slashes only gives ``/``.
    """
    name = F.regexp_extract(location, AUTHORITY + r"(?:[^?#]*?/)?([^/?#]*)/*(?:[?#]|\z)", 1)
    slashes = location.rlike(AUTHORITY + "/")
    return F.coalesce(F.nullif(name, F.lit("")), F.when(slashes, "/").otherwise("."))
