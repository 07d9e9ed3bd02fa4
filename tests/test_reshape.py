import pytest

from tiersmith import operators as ops


def test_sub_keys_and_clashes(spark):
    df = spark.createDataFrame(
        [
            (1, 1, "x.label.app.io/name", "a"),
            (2, 1, "x.label.io/name", "b"),
            (3, 1, "see-x.label.team", "c"),
            (4, 1, "x.label.team", None),
            (5, 1, "y.label.z", "d"),
            (6, 1, None, "e"),
        ],
        "seq long, entity long, key string, value string",
    )
    last = {(r.subkey, r.value) for r in ops.extract_prefixed(df, ["x.label."]).collect()}
    assert last == {("io/name", "b"), ("team", "c")}
    after = {(r.subkey, r.value) for r in ops.extract_prefixed(df, ["x.label."], "after_prefix").collect()}
    assert after == {("app.io/name", "a"), ("io/name", "b"), ("team", "c")}
    both = ops.extract_prefixed(df, ["x.label.", "label.", "none"])
    assert {r.prefix for r in both.collect()} == {"x.label.", "label."}
    with pytest.raises(ValueError):
        ops.extract_prefixed(df, ["x"], "other")


def test_unset_columns_and_flags(spark):
    df = spark.createDataFrame(
        [(1, True, 3, None), (2, False, 4, "x"), (3, None, 5, "y"), (4, True, None, None)],
        "entity long, on boolean, n int, text string",
    )
    out = ops.unpivot_present(df, {"n": "size", "text": "note"}, "on", {"enabled": "true", "tracked": "true"})
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 1, "enabled", "true"),
        (1, 2, "tracked", "true"),
        (1, 3, "size", "3"),
        (4, 1, "enabled", "true"),
        (4, 2, "tracked", "true"),
    ]
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "entity long, jars array<string>")
    joined = ops.unpivot_present(lists, {"jars": "jars"})
    assert [tuple(r) for r in joined.collect()] == [(1, 1, "jars", "a,b")]
    always = ops.unpivot_present(df, {"text": "note"})
    assert sorted((r.entity, r.value) for r in always.collect()) == [(2, "x"), (3, "y")]


def test_option_rows_by_kind(spark):
    df = spark.createDataFrame(
        [
            (1, "a", "hostPath", "/m", "/h", "Directory", None),
            (1, "b", "hostPath", "/m", "/h", None, None),
            (1, "c", "emptyDir", "/m", None, None, None),
            (1, "d", "claim", "/m", None, None, "pvc"),
            (1, "e", "other", "/m", "/h", "x", "y"),
            (1, "f", None, "/m", "/h", "x", "y"),
        ],
        "parent long, name string, kind string, path string, host_path string, host_type string, claim_name string",
    )
    got = sorted((r.name, r.option, r.value) for r in ops.expand_options(df, ops.VOLUME_OPTIONS).collect())
    assert got == [
        ("a", "mount.path", "/m"),
        ("a", "options.path", "/h"),
        ("a", "options.type", "Directory"),
        ("b", "mount.path", "/m"),
        ("b", "options.path", "/h"),
        ("c", "mount.path", "/m"),
        ("d", "mount.path", "/m"),
        ("d", "options.claimName", "pvc"),
    ]


def test_split_semantics(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "/a,/b,"), (4, " x ,"), (5, "a.b")], "entity long, dirs string")
    got = sorted(tuple(r) for r in ops.explode_list(df, "dirs").collect())
    assert got == [(1, 1, ""), (3, 1, "/a"), (3, 2, "/b"), (3, 3, ""), (4, 1, " x "), (4, 2, ""), (5, 1, "a.b")]
    dots = ops.explode_list(df.where("entity = 5"), "dirs", separator=".")
    assert [r.item for r in dots.orderBy("pos").collect()] == ["a", "b"]


def test_sources_keep_duplicates_and_tags(spark):
    one = spark.createDataFrame([(1, "a")], "entity long, value string")
    out = ops.collect_sources({"first": one, "second": one.select("value", "entity"), "third": one})
    assert sorted((r.entity, r.value, r.source, r.source_pos) for r in out.collect()) == [
        (1, "a", "first", 1),
        (1, "a", "second", 2),
        (1, "a", "third", 3),
    ]
