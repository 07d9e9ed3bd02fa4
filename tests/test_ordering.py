"""Large groups are split; numbers, totals and parts stay exact."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiersmith import operators as ops


def sample(seed, n, hot=0.34, keys=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < hot else rng.choice([None, *[f"g{k}" for k in range(keys)]])
        rows.append((group, rng.randrange(n // 2), i, rng.randrange(4)))
    return rows


def brute(rows, step):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    out = {}
    for members in groups.values():
        total = 0
        for row in sorted(members, key=lambda r: (r[1], r[2])):
            total += step(row)
            out[row[2]] = total
    return out


@pytest.mark.parametrize("hot_group", ["hot", None])
def test_numbers_of_a_split_group(spark, hot_group):
    rows = [(hot_group if g == "hot" else g, a, b, c) for g, a, b, c in sample(1, 6000)]
    df = spark.createDataFrame(rows, "g string, a long, b long, c int").repartition(5)
    hot = ops.hot_groups(df, ["g"], 400)
    assert [r.g for r in hot.table.collect()] == [hot_group] and 4 < hot.ranges < 12
    got = {r.b: r.pos for r in ops.number_rows(df, ["g"], ["a", "b"], bucket_rows=400).collect()}
    assert got == brute(rows, lambda r: 1)


def test_running_total_of_a_split_group(spark):
    rows = sample(2, 4000)
    df = spark.createDataFrame(rows, "g string, a long, b long, c int")
    out = ops.running_total(df, ["g"], ["a", "b"], df.c, "total", ops.hot_groups(df, ["g"], 300))
    assert {r.b: r.total for r in out.collect()} == brute(rows, lambda r: r[3])


def test_ordinary_groups_are_not_split(spark):
    df = spark.range(20000).selectExpr("id % 2000 as g", "id as a")
    assert ops.hot_groups(df, ["g"], 16) is None
    assert ops.hot_groups(df.where("false"), ["g"], 16) is None


def test_a_third_of_all_rows_are_copies(spark):
    rows = [("hot", 50, i % 3) for i in range(3000)] + [("hot", i % 100, 9) for i in range(1500)]
    rows += [(f"g{i % 700}", 1, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, a long, b long").repartition(6)
    numbered = ops.number_rows(df, ["g"], ["a"], bucket_rows=160).collect()
    assert sorted((r.g, r.a, r.b) for r in numbered) == sorted(rows)
    groups = defaultdict(list)
    for r in numbered:
        groups[r.g].append((r.pos, r.a))
    for members in groups.values():
        members.sort()
        assert [pos for pos, _ in members] == list(range(1, len(members) + 1))
        assert [a for _, a in members] == sorted(a for _, a in members)


def test_ranges_of_a_hot_group_are_even(spark):
    """Also where a third of its rows are one order value."""
    rows = [("hot", 50 if i % 3 else i % 100, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, a long, b long").repartition(6)
    hot = ops.hot_groups(df, ["g"], 500)
    placed = df.repartitionByRange(hot.ranges, "g", "a", F.xxhash64(*df.columns))
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 3 * 500


def test_parts_follow_from_positions(spark):
    df = spark.range(1, 8).select("id", ops.part_of(F.col("id"), 3).alias("part"))
    assert [r.part for r in df.orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_large_groups_are_found_in_another_table(spark):
    rows = sample(3, 3000)
    df = spark.createDataFrame(rows, "g string, a long, b long, c int")
    kept = df.where("c > 0")
    out = ops.number_rows(kept, ["g"], ["a", "b"], bucket_rows=64, sizing=df)
    assert {r.b: r.pos for r in out.collect()} == brute([r for r in rows if r[3] > 0], lambda r: 1)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([16, 200]))
def test_split_and_plain_numbers_agree(spark, seed, bucket_rows):
    rows = sample(seed, 1500, hot=0.6, keys=5)
    df = spark.createDataFrame(rows, "g string, a long, b long, c int")
    got = {r.b: r.pos for r in ops.number_rows(df, ["g"], ["a", "b"], bucket_rows=bucket_rows).collect()}
    assert got == brute(rows, lambda r: 1)
