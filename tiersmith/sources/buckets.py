"""A state in hash buckets, of which an update writes only those that it touches.

Below the path of a state are ``data/version=N`` folders, each with the buckets
that one write produced, and ``manifests``, one small JSON file for each version: which
folder holds the current rows of each bucket. A version begins to count when its
manifest is in place, the last step of a write; what a failed write left is
never read. The number of buckets is fixed when the state is created, and with it
the size of a manifest. One writer at a time: a second one that finds its version
taken stops.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiersmith.operators.reconcile import apply_plan, wanted_rows
from tiersmith.session import ensure_checkpoint_dir

_BUCKET = "_ts_bucket"
_MANIFEST = re.compile(r"(\d{10})\.json")


class Manifest(NamedTuple):
    """A version of a state: its number, keys and schema, and the version that wrote each bucket."""

    version: int
    buckets: int
    keys: tuple[str, ...]
    schema: StructType
    written: dict[int, int]


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _folder(spark, path)
    place = hadoop.Path(path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def _manifests(spark: SparkSession, path: str) -> list[int]:
    found = [_MANIFEST.fullmatch(name) for name in _names(spark, f"{path}/manifests")]
    return sorted(int(m[1]) for m in found if m)


def _data_versions(spark: SparkSession, path: str) -> list[int]:
    names = [n.removeprefix("version=") for n in _names(spark, f"{path}/data") if n.startswith("version=")]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """A version of a state, by default the last one."""
    versions = _manifests(spark, path)
    if not versions or version is not None and version not in versions:
        raise ValueError(f"no complete state below {path}" if version is None else f"no version {version} below {path}")
    number = versions[-1] if version is None else version
    lines = spark.read.option("wholetext", True).text(f"{path}/manifests/{number:010d}.json").collect()
    read = json.loads(lines[0]["value"])
    schema = StructType.fromJson(read["schema"])
    return Manifest(number, read["buckets"], tuple(read["keys"]), schema, {int(b): v for b, v in read["written"].items()})


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    fs, hadoop = _folder(spark, path)
    final = hadoop.Path(f"{path}/manifests/{new.version:010d}.json")
    draft = hadoop.Path(f"{path}/manifests/.{new.version:010d}.draft")
    text = {"buckets": new.buckets, "keys": new.keys, "schema": new.schema.jsonValue(), "written": new.written}
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(text).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {new.version} of {path} was written by somebody else")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a row: a hash of its keys, nulls included."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, version: int, keys: Sequence[str], buckets: int, tasks: int) -> set[int]:
    """Write rows by bucket and return the buckets that have any."""
    place = f"{path}/data/version={version}"
    spread = rows.withColumn(_BUCKET, bucket_of(keys, buckets)).repartition(tasks, _BUCKET)
    spread.write.mode("error").partitionBy(_BUCKET).parquet(place)
    names = _names(rows.sparkSession, place)
    return {int(n.removeprefix(f"{_BUCKET}=")) for n in names if n.startswith(f"{_BUCKET}=")}


def _read(spark: SparkSession, path: str, known: Manifest, buckets: Sequence[int]) -> DataFrame:
    places = [f"{path}/data/version={known.written[b]}/{_BUCKET}={b}" for b in buckets if b in known.written]
    if not places:
        return spark.createDataFrame([], known.schema)
    return spark.read.schema(known.schema).parquet(*places)


def create_buckets(rows: DataFrame, path: str, keys: Sequence[str] = ("ns", "name"), buckets: int = 256) -> int:
    """Write ``rows`` as a new state in ``buckets`` buckets by a hash of ``keys``; returns its version.

    A bucket is what an update rewrites at least, and one task writes it: choose so many that it holds some hundred MB.
    """
    spark = rows.sparkSession
    if _manifests(spark, path):
        raise ValueError(f"there is a state below {path}")
    version = max(_data_versions(spark, path), default=0) + 1
    written = _write(rows, path, version, keys, buckets, buckets)
    _commit(spark, path, Manifest(version, buckets, tuple(keys), rows.schema, dict.fromkeys(sorted(written), version)))
    return version


def read_buckets(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a state, of its last version or an earlier one that is still there."""
    known = manifest(spark, path, version)
    return _read(spark, path, known, sorted(known.written))


def update_buckets(changes: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Merge ``changes`` into a state and return the new version.

    ``merge(old, changes)`` gets the rows of the touched buckets, those that a key of
    the changes falls into, and returns what they hold from now on, in the columns
    of the state; it must not change keys. All other buckets stay where they are. The
    changes are checkpointed once, so that finding the buckets and merging agree.
    """
    spark = changes.sparkSession
    known = manifest(spark, path)
    ensure_checkpoint_dir(spark)
    changes = changes.checkpoint()
    touched = changes.select(bucket_of(known.keys, known.buckets).alias("b")).distinct().collect()  # at most all buckets
    touched = sorted(r["b"] for r in touched)
    version = max([known.version, *_data_versions(spark, path)]) + 1
    written = dict(known.written)
    if touched:
        merged = merge(_read(spark, path, known, touched), changes).select(*known.schema.names)
        filled = _write(merged, path, version, known.keys, known.buckets, len(touched))
        if not filled <= set(touched):
            raise ValueError("a merge must not change keys")
        written = {b: v for b, v in written.items() if b not in touched} | dict.fromkeys(sorted(filled), version)
    _commit(spark, path, known._replace(version=version, written=written))
    return version


def upsert_buckets(desired: DataFrame, path: str, payload: Sequence[str] = ("payload",), seq: str | None = None) -> int:
    """Apply the upsert of ``desired`` rows to a state in buckets: see ``upsert_plan`` and ``apply_plan``."""
    keys = manifest(desired.sparkSession, path).keys
    wanted = wanted_rows(desired, keys, payload, seq)
    return update_buckets(wanted, path, lambda old, new: apply_plan(new, old, keys, payload))


def vacuum_buckets(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete what none of the last ``keep`` versions needs, and return the numbers of the data folders that are gone.

    Not to be run beside a writer, or while an older version is read."""
    versions = _manifests(spark, path)
    kept = versions[-keep:]
    needed = {v for number in kept for v in manifest(spark, path, number).written.values()}
    fs, hadoop = _folder(spark, path)
    for number in versions[:-keep]:
        fs.delete(hadoop.Path(f"{path}/manifests/{number:010d}.json"), False)
    gone = [v for v in _data_versions(spark, path) if v not in needed]
    for v in gone:
        fs.delete(hadoop.Path(f"{path}/data/version={v}"), True)
    return gone
