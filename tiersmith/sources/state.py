"""Sink of a reconciled state: whole versions, of which the last complete one counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

VERSION = "version="


def _versions(spark: SparkSession, path: str, complete: bool) -> list[int]:
    """Numbers of the versions below ``path``; those that were written to their end, or all."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    numbers = [int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION) and n.removeprefix(VERSION).isdigit()]
    return sorted(n for n in numbers if not complete or fs.exists(hadoop.Path(f"{path}/{VERSION}{n}/_SUCCESS")))


def write_state(state: DataFrame, path: str, keys: Sequence[str] = ("ns", "name"), partitions: int | None = None) -> int:
    """Write a state as parquet into a new version folder and return its number.

    Rows are spread by a hash of all keys, so a namespace that holds much of the
    state does not fill one task; Spark sizes the tasks unless ``partitions``
    says how many. Earlier versions stay as they are, so the state may be
    derived from the one that is there, and a write that fails leaves it valid.
    """
    versions = _versions(state.sparkSession, path, complete=False)
    number = versions[-1] + 1 if versions else 1
    spread = state.repartition(*keys) if partitions is None else state.repartition(partitions, *keys)
    spread.write.mode("error").parquet(f"{path}/{VERSION}{number}")
    return number


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a state."""
    versions = _versions(spark, path, complete=True)
    if not versions:
        raise ValueError(f"no complete state below {path}")
    return spark.read.parquet(f"{path}/{VERSION}{versions[-1]}")
