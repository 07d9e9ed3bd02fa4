"""Run a query on Spark and its oracle on DuckDB and compare the rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    place = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(row[i] for i in place) for row in result.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row) for row in df.select(*names).collect())


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    want_names, want = duck_rows(con, sql)
    got_names, got = spark_rows(df)
    assert got_names == want_names
    missing, extra = want - got, got - want
    assert not missing and not extra, f"missing {list(missing)[:3]}, extra {list(extra)[:3]}"
    return sum(got.values())
