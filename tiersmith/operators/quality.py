"""Cleaning: code spellings, integer text, locations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tiersmith.functions.numbers import parse_integer
from tiersmith.functions.text import base_name, location_scheme
from tiersmith.operators.joins import split_join

# Runtime spellings, and schemes by how a location is reached.
RUNTIME_CODES = {"Scala": "java", "Java": "java", "Python": "python", "R": "r"}
IN_PLACE_SCHEMES = ("file", "local")
FETCH_SCHEMES = ("http", "https", "ftp")


def normalise_codes(
    df: DataFrame,
    col: str = "code",
    mapping: Mapping[str, str] | DataFrame = RUNTIME_CODES,
    out: str = "canonical",
) -> DataFrame:
    """Canonical code of a spelling; unknown spellings pass through unchanged.

    A mapping given as a dictionary is part of the expression. A table of
    (spelling, canonical) is joined; Spark broadcasts it if it is small. A spelling
    that occurs in it more than once gets the smallest of its canonical codes, and
    rows are never multiplied.
    """
    if isinstance(mapping, DataFrame):
        table = mapping.groupBy(F.col("spelling").alias(col)).agg(F.min("canonical").alias("_ts_canonical"))
        joined = split_join(df, table, [col], "left")
        known = F.coalesce("_ts_canonical", col).alias(out)
        return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], known)
    pairs = F.create_map(*[F.lit(text) for pair in mapping.items() for text in pair])
    return df.withColumn(out, F.coalesce(F.element_at(pairs, F.col(col)), F.col(col)))


def parse_or_quarantine(
    df: DataFrame,
    col: str,
    default: int,
    policy: str = "default",
    out: str = "parsed",
    target: str = "int",
    observation: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read integer text; returns (good, bad).

    Absent text gives the default and is not reported. Malformed text is in
    ``bad`` and, by policy: ``default`` takes the default, ``quarantine`` leaves
    the row out of ``good``, ``fail`` stops the job that reads ``good``.
    ``good`` has a ``status`` of parsed, absent or defaulted.

    An ``observation`` counts what is found (n_rows, n_absent, n_malformed) in the
    job that reads ``good``, without a scan of its own; it is complete once that
    job has ended.
    """
    read = df.withColumn("_number", parse_integer(F.col(col), target))
    malformed = F.col(col).isNotNull() & F.col("_number").isNull()
    seen = read
    if observation is not None:
        counts = {"n_rows": F.count("*"), "n_absent": F.count_if(F.col(col).isNull()), "n_malformed": F.count_if(malformed)}
        seen = read.observe(observation, *[c.alias(name) for name, c in counts.items()])
    bad = read.where(malformed).drop("_number")
    status = F.when(F.col(col).isNull(), "absent").when(malformed, "defaulted").otherwise("parsed")
    if policy == "quarantine":
        rows = seen.where(~malformed)
    elif policy == "fail":
        message = F.concat(F.lit(f"{col} is not an integer: "), F.col(col))
        rows = seen.where(F.when(malformed, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    elif policy == "default":
        rows = seen
    else:
        raise ValueError(f"unknown policy {policy!r}")
    value = F.coalesce("_number", F.lit(default).cast(target))
    return rows.withColumns({out: value, "status": status}).drop("_number"), bad


def classify_locations(df: DataFrame, col: str = "location") -> DataFrame:
    """Add ``scheme``, ``route`` and ``base_name`` of a location.

    Routes: in_place, fetch, unsupported (any other scheme, or none), error
    (empty text) and absent (null).
    """
    place = F.col(col)
    scheme = F.col("scheme")
    route = (
        F.when(place.isNull(), "absent")
        .when(place == "", "error")
        .when(scheme.isin(*IN_PLACE_SCHEMES), "in_place")
        .when(scheme.isin(*FETCH_SCHEMES), "fetch")
        .otherwise("unsupported")
    )
    name = F.when(place != "", base_name(place))
    return df.withColumn("scheme", location_scheme(place)).withColumns({"route": route, "base_name": name})


def location_summary(classified: DataFrame) -> DataFrame:
    """Locations per scheme and route."""
    return classified.groupBy("scheme", "route").agg(F.count("*").alias("n"))
