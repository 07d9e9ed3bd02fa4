from pyspark.sql import functions as F

from tiersmith import operators as ops
from tiersmith.functions import ladder
from tiersmith.plans import local_directories, service_labels

LOG = "seq long, entity long, key string, layer string, value string"
ORDER = ["override", "spec", "conf"]


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def resolved(spark, rows, presence, order=ORDER, entities=(1,)):
    people = spark.createDataFrame([(e,) for e in entities], "entity long")
    out = ops.resolve_layers(log(spark, *rows), order, people, {"k": "0"}, presence)
    return {(r.entity, r.key): (r.value, r.layer) for r in out.collect()}


def test_last_write_wins_and_null_is_not_a_write(spark):
    df = log(
        spark,
        (1, 1, "jars", "spec", "deps"),
        (2, 1, "jars", "spec", "main"),
        (3, 1, "jars", "spec", None),
        (4, 1, "opt", "spec", "x"),
        (5, 1, "opt", "spec", ""),
        (6, 2, "none", "spec", None),
    )
    got = {(r.entity, r.key): r.value for r in ops.latest_setting(df).collect()}
    assert got == {(1, "jars"): "main", (1, "opt"): ""}


def test_presence_rules_differ(spark):
    rows = [(1, 1, "k", "override", None), (2, 1, "k", "spec", ""), (3, 1, "k", "conf", "c")]
    assert resolved(spark, rows, "non_empty") == {(1, "k"): ("c", "conf")}
    assert resolved(spark, rows, "not_null") == {(1, "k"): ("", "spec")}
    assert resolved(spark, rows, "key_exists") == {(1, "k"): (None, "override")}


def test_a_later_empty_write_replaces_the_earlier_one_of_its_layer(spark):
    rows = [(1, 1, "k", "spec", "old"), (2, 1, "k", "spec", ""), (3, 1, "k", "conf", "c")]
    assert resolved(spark, rows, "non_empty") == {(1, "k"): ("c", "conf")}


def test_constant_default_and_unknown_layers_and_entities(spark):
    rows = [(1, 1, "k", "elsewhere", "x"), (2, 9, "k", "spec", "y"), (3, 2, "other", "spec", "z")]
    got = resolved(spark, rows, "non_empty", entities=(1, 2))
    assert got == {(1, "k"): ("0", "constant"), (2, "k"): ("0", "constant")}


def test_layer_table_gives_the_same_as_a_list(spark):
    rows = [
        (1, 1, "k", "conf", "c"),
        (2, 1, "k", "spec", ""),
        (3, 2, "k", "spec", "s"),
        (4, 2, "k", "override", None),
        (5, 3, "k", "elsewhere", "x"),
        (6, 4, "k", "conf", "first"),
        (7, 4, "k", "conf", "second"),
    ]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(ORDER, 1)], "layer string, layer_rank int")
    for presence in ("non_empty", "not_null", "key_exists"):
        by_list = resolved(spark, rows, presence, ORDER, (1, 2, 3, 4, 5))
        assert by_list == resolved(spark, rows, presence, table, (1, 2, 3, 4, 5))


def test_both_merge_orders(spark):
    df = log(
        spark,
        (1, 1, "a", "driver", "d"),
        (2, 1, "a", "app", "p"),
        (3, 1, "b", "driver", "d2"),
        (4, 1, "b", "driver", None),
    )
    one = ops.merge_layer_maps(df, ["driver", "app"]).collect()
    assert [(r.entity, r.part, r.n_keys, r.settings) for r in one] == [(1, 0, 2, {"a": "p", "b": "d2"})]
    other = ops.merge_layer_maps(df, ["app", "driver"]).collect()
    assert other[0].settings == {"a": "d", "b": "d2"}


def test_large_maps_come_in_parts(spark):
    df = spark.range(5000).selectExpr(
        "id as seq", "id % 10 div 9 as entity", "concat('k', lpad(id div 2, 5, '0')) as key", "'a' as layer", "string(id) as value"
    )
    whole = {(r.entity, r.key): r.value for r in ops.merge_layers(df, ["a"]).collect()}
    parts = ops.merge_layer_maps(df, ["a"], part_keys=200).orderBy("entity", "part").collect()
    assert len(parts) > 6
    assert {(r.entity, k): v for r in parts for k, v in r.settings.items()} == whole
    sorted_keys = ops.merge_layer_maps(df, ["a"], part_keys=200).selectExpr("entity", "part", "map_keys(settings) as keys")
    for entity in (0, 1):
        keys = [k for r in sorted_keys.where(f"entity = {entity}").orderBy("part").collect() for k in r["keys"]]
        assert keys == sorted(keys)
    assert all(r.n_keys <= 200 for r in parts)
    hot = ops.merge_layer_maps(df, ["a"], part_keys=200, bucket_rows=300)
    assert sorted((r.entity, r.part, r.n_keys) for r in hot.collect()) == sorted((r.entity, r.part, r.n_keys) for r in parts)


def test_a_layer_may_be_called_constant(spark):
    people = spark.createDataFrame([(1,), (2,)], "entity long")
    df = log(spark, (1, 1, "k", "spec", "write"), (2, 9, "k", "constant", "x"), (3, 2, "k", "constant", "own"))
    ranks = spark.createDataFrame([("constant", 1), ("spec", 2)], "layer string, layer_rank int")
    for order in (["constant", "spec"], ranks):
        out = ops.resolve_layers(df, order, people, {"k": "0"}, "non_empty")
        assert sorted((r.entity, r.value, r.layer) for r in out.collect()) == [(1, "write", "spec"), (2, "own", "constant")]


def test_a_null_entity_is_an_entity_and_a_null_key_is_no_key(spark):
    df = log(spark, (1, None, "k", "spec", "a"), (2, 1, None, "spec", "b"), (3, 1, "k", "spec", "c"))
    people = spark.createDataFrame([(None,), (1,), (2,)], "entity long")
    first = ops.first_nonempty_layer(df.where("key is not null"), ORDER, people, [("d", "x")]).collect()
    assert {(r.entity, r.key, r.value) for r in first} == {(None, "k", "a"), (1, "k", "c"), (2, "d", "x")}
    assert {(r.entity, r.value) for r in ops.latest_setting(df).collect()} == {(None, "a"), (1, "c")}
    assert {(r.entity, r.n_keys) for r in ops.merge_layer_maps(df, ORDER).collect()} == {(None, 1), (1, 1)}


def test_first_nonempty_layer_takes_whole_groups(spark):
    df = log(
        spark,
        (1, 1, "a", "conf", "c1"),
        (2, 1, "b", "conf", "c2"),
        (3, 1, "a", "spec", "s1"),
        (4, 2, "a", "conf", "c3"),
        (5, 2, "a", "conf", "c4"),
        (6, 3, "a", "spec", None),
    )
    people = spark.createDataFrame([(1,), (2,), (3,)], "entity long")
    out = ops.first_nonempty_layer(df, ORDER, people, [("d1", "x"), ("d2", "y")])
    got = sorted((r.entity, r.key, r.value, r.layer) for r in out.collect())
    assert got == [
        (1, "a", "s1", "spec"),
        (2, "a", "c3", "conf"),
        (2, "a", "c4", "conf"),
        (3, "d1", "x", "constant"),
        (3, "d2", "y", "constant"),
    ]


def test_prefixed_labels_override_layers(spark):
    df = spark.createDataFrame(
        [
            (1, 1, "version", "x.version", "driver", "1"),
            (2, 1, "version", "x.version", "app", "2"),
            (3, 1, "team", "pre.label.version", "app", "3"),
        ],
        "seq long, entity long, key string, conf_key string, layer string, value string",
    )
    got = {r.key: r.value for r in service_labels(df, ["driver", "app"], ["pre.label."]).collect()}
    assert got == {"version": "3", "team": "3"}


def test_later_prefixed_write_wins_across_prefixes(spark):
    df = spark.createDataFrame(
        [(1, 1, "k", "p2.team", "app", "old"), (2, 1, "k", "p1.team", "app", "new")],
        "seq long, entity long, key string, conf_key string, layer string, value string",
    )
    got = {r.key: r.value for r in service_labels(df, ["app"], ["p1.", "p2."]).collect()}
    assert got == {"k": "new", "team": "new"}


def test_local_directories_fall_back(spark):
    mounts = spark.createDataFrame(
        [(1, "my-scratch-a", "/m2", 2), (1, "scratch-b", "/m1", 1), (1, "data", "/d", 3), (2, "data", "/d", 1)],
        "entity long, name string, path string, pos int",
    )
    env = spark.createDataFrame([(1, "/e"), (2, "/e1,/e2"), (3, None)], "entity long, text string")
    conf = spark.createDataFrame([(2, "/c"), (3, "/c1,/c1")], "entity long, text string")
    people = spark.createDataFrame([(1,), (2,), (3,), (4,)], "entity long")
    rows, lists = local_directories(mounts, ["pos"], {"env": env, "conf": conf}, people, "scratch-", "/tmp/x", "scratch-")
    assert {r.entity: r.list for r in lists.collect()} == {1: "/m1,/m2", 2: "/e1,/e2", 3: "/c1,/c1", 4: "/tmp/x"}
    assert sorted((r.slot, r.value) for r in rows.where("entity = 2").collect()) == [("scratch-1", "/e1"), ("scratch-2", "/e2")]


def test_ladders_of_a_wide_record(spark):
    df = spark.createDataFrame(
        [("a", "ns", "c"), ("b", "", "c"), ("c", None, ""), ("d", None, None)], "name string, given string, conf string"
    )
    default = F.concat("name", F.lit("-driver"))
    steps = [(F.col("given"), "non_empty"), (F.col("conf"), "key_exists")]
    assert [r.v for r in df.select(ladder(steps, default).alias("v")).collect()] == ["ns", "c", "", "d-driver"]
    assert [r.v for r in df.select(ladder([(F.col("conf"), "non_empty")], "default").alias("v")).collect()] == [
        "c",
        "c",
        "default",
        "default",
    ]
