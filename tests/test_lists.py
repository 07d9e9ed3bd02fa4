"""Written-out lists of children, interval joins, prefix tables, row positions."""

import random

import pytest
from pyspark.sql import functions as F
from test_match import MOUNT, VOLUME, brute_lists, data

from tiersmith import operators as ops


def items_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.pos):
        out.setdefault((r.parent, r.child), []).append((r.pos, r.path))
    return out


def placed_of(spark, mounts, volumes, shared, cumulative):
    parents = spark.createDataFrame([(p, o, "cfg", path) for p, o, path in shared], "parent long, ord long, name string, path string")
    return ops.attach_matching(
        spark.createDataFrame(mounts, MOUNT), spark.createDataFrame(volumes, VOLUME), ["ord"], cumulative, parents if shared else None
    )


@pytest.mark.parametrize("cumulative", [True, False])
@pytest.mark.parametrize("with_shared", [True, False])
def test_written_lists_match_the_sequential_rule(spark, cumulative, with_shared):
    mounts, volumes, shared = data()
    shared = shared if with_shared else []
    placed = placed_of(spark, mounts, volumes, shared, cumulative)
    want = brute_lists(mounts, volumes, shared, cumulative)
    got = items_of(ops.attached_items(placed, cumulative=cumulative).collect())
    assert {k: [p for _, p in v] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all([n for n, _ in v] == list(range(1, len(v) + 1)) for v in got.values())

    lists = {}
    for r in sorted(ops.attached_lists(placed, cumulative=cumulative, part_rows=3).collect(), key=lambda r: r.part):
        assert r.n_items == len(r.mounts) <= 3
        lists.setdefault((r.parent, r.child), []).extend(m.path for m in r.mounts)
    assert lists == want and any(not v for v in want.values())


@pytest.mark.parametrize("cumulative", [True, False])
def test_only_the_lists_that_are_asked_for(spark, cumulative):
    mounts, volumes, shared = data()
    placed = placed_of(spark, mounts, volumes, shared, cumulative)
    asked = ops.attached_children(placed).where("child = 3")
    got = items_of(ops.attached_items(placed, asked, cumulative).collect())
    want = {k: v for k, v in brute_lists(mounts, volumes, shared, cumulative).items() if k[1] == 3 and v}
    assert {k: [p for _, p in v] for k, v in got.items()} == want


def test_a_null_child_has_its_own_list(spark):
    mounts = [(1, None, 1, "v", "/n"), (1, 2, 1, "v", "/2"), (None, 2, 1, "v", "/lost")]
    for cumulative, second in ((True, ["/s", "/n", "/2"]), (False, ["/s", "/2"])):
        placed = placed_of(spark, mounts, [(1, "v")], [(1, 0, "/s")], cumulative)
        got = items_of(ops.attached_items(placed, cumulative=cumulative).collect())
        assert {k: [p for _, p in v] for k, v in got.items()} == {(1, None): ["/s", "/n"], (1, 2): second}


def shuffled_rows(df):
    """Rows that the shuffles of an executed ``df`` wrote."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        if kind == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_running_lists_are_not_shuffled_item_by_item(spark, part_rows):
    n = 300  # children of one parent, whose lists have n * (n + 1) / 2 items
    mounts = [(1, c, 1, "v", f"/{c}") for c in range(n)] + [(2, 1, 1, "none", "/x")]
    placed = placed_of(spark, mounts, [(1, "v")], [], True).checkpoint()
    df = ops.attached_lists(placed, part_rows=part_rows)
    rows = df.collect()
    lists = {}
    for r in sorted(rows, key=lambda r: r.part):
        lists.setdefault((r.parent, r.child), []).extend(m.path for m in r.mounts)
    assert lists == {(1, c): [f"/{k}" for k in range(c + 1)] for c in range(n)} | {(2, 1): []}
    assert sum(r.n_items for r in rows) == n * (n + 1) // 2
    assert shuffled_rows(df) <= len(rows) + 3 * len(mounts) < n * (n + 1) // 4


def test_a_list_ends_with_the_mounts_of_its_parent(spark):
    mounts = [(1, c, 1, "v", f"/{c}") for c in range(5)]
    placed = placed_of(spark, mounts, [(1, "v")], [], True)
    asked = spark.createDataFrame([(1, 4, 50), (1, 9, 0), (1, None, 3), (7, 1, 9), (None, 2, 9)], "parent long, child long, last_pos long")
    got = sorted(((str(r.parent), str(r.child), r.part, r.n_items, [m.path for m in r.mounts]) for r in ops.attached_lists(placed, asked, part_rows=2).collect()))
    whole = [(0, 2, ["/0", "/1"]), (1, 2, ["/2", "/3"]), (2, 1, ["/4"])]
    want = [("1", "4", *x) for x in whole] + [("1", "9", 0, 0, []), ("7", "1", 0, 0, []), ("None", "2", 0, 0, [])]
    assert got == sorted([*want, ("1", "None", 0, 2, ["/0", "/1"]), ("1", "None", 1, 1, ["/2"])])


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_interval_join_equals_brute_force(spark, bucket):
    rng = random.Random(bucket)
    items = [(rng.choice([1, 2, None]), rng.randrange(1, 30), i) for i in range(80)]
    spans = [(rng.choice([1, 2, 3, None]), rng.randrange(1, 30), rng.randrange(0, 40), f"s{i}") for i in range(30)]
    got = ops.interval_join(
        spark.createDataFrame(items, "k long, pos long, item long"), spark.createDataFrame(spans, "k long, a long, b long, span string"), ["k"], first="a", last="b", bucket=bucket
    )
    want = sorted((i, s) for k, pos, i in items for q, a, b, s in spans if k is not None and k == q and a <= pos <= b)
    assert sorted((r.item, r.span) for r in got.collect()) == want and len(want) > 50


def test_a_hot_parent_is_split_and_never_crossed(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000"}
    conf |= {"spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spans = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 = 0, 0, id) as parent", "id as child", "1 as last_pos")
        items = spark.range(0, 60_000, 1, 8).selectExpr("if(id < 5, 0, id) as parent", "1 as pos", "id as item")
        df = ops.interval_join(items, spans, ["parent"])
        assert df.count() == 5 * 20_000 + (40_000 - 3)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def brute_matches(keys, prefixes, anywhere, longest):
    found = {(k, p) for k in keys if k is not None for p in prefixes if p is not None and (p in k if anywhere else k.startswith(p))}
    if longest:
        return {(k, min((p for q, p in found if q == k), key=lambda p: (-len(p), p))) for k, _ in found}
    return found


@pytest.mark.parametrize("anywhere", [True, False])
@pytest.mark.parametrize("longest", [True, False])
def test_prefix_tables_equal_brute_force(spark, anywhere, longest):
    rng = random.Random(3)
    keys = [None, "", "a", "é.é"] + ["".join(rng.choice("ab.é") for _ in range(rng.randrange(12))) for _ in range(120)]
    prefixes = [None, "zz", "a" * 40] + ["".join(rng.choice("ab.é") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    for rules in (prefixes, [*prefixes, ""], [None], []):
        rows = spark.createDataFrame([(k,) for k in [*keys, *keys]], "key string")
        table = spark.createDataFrame([(p,) for p in rules], "prefix string")
        got = [tuple(r) for r in ops.prefix_matches(rows, "key", table, anywhere, longest).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_matches(keys, rules, anywhere, longest)


def test_lists_and_tables_of_prefixes_agree(spark):
    log = spark.createDataFrame(
        [(1, "x.app.label.a", "1", 1), (1, "y.app.label.a", "2", 2), (2, "app.label.app.lab", "3", 3), (2, "app", None, 4), (None, "app.label.b", "5", 5), (3, "zzz", "6", 6)],
        "entity long, key string, value string, seq long",
    )
    rules = ["app.label.", "app.", "lab", "none"]
    table = spark.createDataFrame([(p,) for p in [*rules, "app."]], "prefix string")
    for longest in (False, True):
        for mode in ("last_segment", "after_prefix"):
            found = [{tuple(r) for r in ops.extract_prefixed(log, p, mode, longest=longest).collect()} for p in (rules, table)]
            assert found[0] == found[1] and len(found[0]) == (3 if longest else 9)


def test_ten_thousand_prefixes_are_a_hash_join(spark):
    rules = spark.range(10_000).selectExpr("concat('rule-', id, '.') as prefix")
    log = spark.range(2_000).selectExpr("id as entity", "concat('k.rule-', id * 7, '.x', id) as key", "'v' as value", "id as seq")
    df = ops.extract_prefixed(log, rules)
    assert df.count() == len([i for i in range(2_000) if i * 7 < 10_000])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan


def test_volumes_by_a_table_of_prefixes(spark):
    volumes = spark.createDataFrame([(1, "scratch-a"), (1, "data"), (2, "tmp"), (2, None)], VOLUME)
    mounts = spark.createDataFrame([(1, "scratch-a", "/1"), (1, "data", "/2"), (2, "tmp", "/3"), (2, None, "/4"), (1, "scratch-a", "/5")], "parent long, name string, path string")
    rules = spark.createDataFrame([("scratch-",), ("t",), ("ata",)], "prefix string")
    special, rest = ops.split_volumes(volumes, rules)
    assert sorted(r.name for r in special.collect()) == ["scratch-a", "tmp"] and {r.name for r in rest.collect()} == {"data", None}
    matched, residual = ops.match_split(mounts, volumes, rules)
    assert sorted(r.path for r in matched.collect()) == ["/1", "/3", "/5"] and sorted(r.path for r in residual.collect()) == ["/2", "/4"]


def test_rows_are_numbered_as_they_stand_in_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 5_000, 1, 7).selectExpr("id", "id % 10 as digit", "7 as row_pos").write.option("parquet.block.size", 4096).parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("2000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = spark.read.parquet(path).where("digit <> 3").select("id", F.col("digit").alias("d"))
            numbered = ops.row_positions(rows).collect()
            found.append(sorted((r.row_pos, r.id) for r in numbered))
            kept = [i for i in range(5_000) if i % 10 != 3]
            assert found[-1] == list(enumerate(kept, start=1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1]
    again = ops.row_positions(spark.read.parquet(path), "row_pos")
    assert again.columns == ["id", "digit", "row_pos"] and again.agg(F.max("row_pos")).first()[0] == 5_000


def test_positions_of_rows_that_are_in_no_file(spark):
    rows = spark.createDataFrame([(i,) for i in range(100)], "id long")
    assert sorted((r.row_pos, r.id) for r in ops.row_positions(rows).collect()) == [(i + 1, i) for i in range(100)]
    shuffled = spark.range(1_000).repartition(5).withColumn("x", F.rand())
    numbered = ops.row_positions(shuffled)
    assert sorted(r.row_pos for r in numbered.collect()) == list(range(1, 1_001))
    assert ops.row_positions(rows.where("id < 0")).count() == 0


def test_sources_keep_the_order_of_their_rows(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(50).selectExpr("50 - id as v").repartition(3).sortWithinPartitions("v").write.parquet(str(tmp_path / name))
    sources = {name: spark.read.parquet(str(tmp_path / name)) for name in ("a", "b", "a")}
    runs = [sorted((r.source_pos, r.row_pos, r.v) for r in ops.collect_sources(sources, "row_pos").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and [r[:2] for r in runs[0]] == [(s, p) for s in (1, 2) for p in range(1, 51)]
    assert "row_pos" not in ops.collect_sources(sources).columns
