import gzip
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from tiersmith import operators as ops
from tiersmith.sources import read_property_lines, write_documents

ROWS = "entity long, key string, value string"


def load_text(spark, *lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line_no long, line string")
    return [(r.key, r.value) for r in ops.load_documents(df).orderBy("line_no").collect()]


def test_render_orders_escapes_and_strips(spark):
    df = spark.createDataFrame(
        [(1, "b", "x:y=z"), (1, "a", "x:y=z"), (1, "c", "p\nq:r"), (1, "d", "back\\slash"), (1, "e", None), (2, "a", "1")], ROWS
    )
    out = ops.render_documents(df, escape_keys=["a", "c"], strip_keys=["c"])
    got = {r.entity: (r.part, r.n_lines, r.document) for r in out.collect()}
    assert got == {1: (0, 5, "a=x\\:y\\=z\nb=x:y=z\nc=pq\\:r\nd=back\\\\slash\ne=\n"), 2: (0, 1, "a=1\n")}
    raw = ops.render_documents(df.where("key = 'd'"), exact=False).first()
    assert raw.document == "d=back\\slash\n"


@pytest.mark.parametrize("value", ["a\nb", "a\rb"])
def test_line_breaks_are_rejected(spark, value):
    df = spark.createDataFrame([(1, "k", value)], ROWS)
    with pytest.raises(PySparkException, match="line break in the key or value of k"):
        ops.render_documents(df).collect()


def test_load_lines(spark):
    got = load_text(
        spark,
        "# note",
        "  ! note",
        "",
        "   ",
        "a=1",
        "b : 2",
        "c 3 4",
        "d",
        "e=x\\:y\\=z",
        "f\\=g=h",
        "i=a=b:c",
        "  j\t=  k  ",
        "l=\\\\n\\n\\t.",
        "m\\\\=n",
        "=o",
    )
    assert got == [
        ("a", "1"),
        ("b", "2"),
        ("c", "3 4"),
        ("d", ""),
        ("e", "x:y=z"),
        ("f=g", "h"),
        ("i", "a=b:c"),
        ("j", "k  "),
        ("l", "\\n\n\t."),
        ("m\\", "n"),
        ("", "o"),
    ]


def test_long_lines(spark):
    long = "x" * 300_000
    got = load_text(spark, long, f"k={long}", f"k{long}=v", f"k={'a:b=c ' * 50_000}", "\\:" * 500 + "=v")
    assert got == [(long, ""), ("k", long), (f"k{long}", "v"), ("k", "a:b=c " * 50_000), (":" * 500, "v")]


def test_broken_rows_are_stripped_or_set_aside(spark):
    df = spark.createDataFrame([(1, "a", "x\ny"), (1, "b\r", "1"), (1, "c", "2"), (1, None, "3")], ROWS)
    strip = ops.render_documents(df, on_break="strip").first()
    assert (strip.n_lines, strip.document) == (3, "a=xy\nb=1\nc=2\n")
    kept = ops.render_documents(df, on_break="quarantine").first()
    assert (kept.n_lines, kept.document) == (1, "c=2\n")
    assert sorted(r.key for r in ops.broken_rows(df).collect()) == ["a", "b\r"]
    with pytest.raises(ValueError):
        ops.render_documents(df, on_break="other")


def test_unicode_escapes_and_blank_lines(spark):
    got = load_text(spark, "u=\\u0041\\u00e9!", "s=\\ud83d\\ude00", "lone=\\ud83d", "bad=\\u12", "\t", " \f", "end=a\\")
    assert got == [("u", "Aé!"), ("s", "\U0001f600"), ("lone", "ud83d"), ("bad", "u12"), ("end", "a\\")]


ANY = st.text(alphabet="ab:=\\ #!.\t\f\0é\u2028u0041", max_size=8)


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(ANY, ANY, min_size=1, max_size=12), st.booleans())
def test_keys_and_values_survive_a_round_trip(spark, rows, escape):
    df = spark.createDataFrame([(1, k, v) for k, v in rows.items()], ROWS)
    documents = ops.render_documents(df, list(rows) if escape else [], part_lines=3)
    loaded = ops.load_documents(ops.document_lines(documents))
    assert {r.key: r.value for r in loaded.collect()} == rows


def test_large_documents_come_in_parts(spark):
    df = spark.range(4000).selectExpr("int(id % 4 = 0) as entity", "lpad(id * 7919 % 10007, 5, '0') as key", "string(id) as value")
    parts = ops.render_documents(df, part_lines=160).orderBy("entity", "part").collect()
    assert [(r.entity, r.part) for r in parts] == [(0, p) for p in range(19)] + [(1, p) for p in range(7)]
    assert all(r.n_lines == 160 or r.part in (18, 6) for r in parts)
    whole = {r.entity: r.document for r in ops.render_documents(df).collect()}
    for entity, document in whole.items():
        assert "".join(r.document for r in parts if r.entity == entity) == document


def test_files_round_trip(spark, tmp_path):
    df = spark.range(3000).selectExpr("id % 3 as entity", "concat('k', id) as key", "concat('v:', id) as value")
    path = str(tmp_path / "documents")
    write_documents(ops.render_documents(df, part_lines=160), path)
    folders = [d for _, dirs, _ in os.walk(path) for d in dirs if d.startswith("part=")]
    assert len(folders) > 3
    lines, _ = read_property_lines(spark, path)
    loaded = ops.load_documents(lines)
    assert {(r.entity, r.key, r.value) for r in loaded.collect()} == {(str(r.entity), r.key, r.value) for r in df.collect()}
    ordered = lines.where("entity = '0'").orderBy("part", "block_start", "line_id")
    keys = [r.line.split("=")[0] for r in ordered.collect()]
    assert keys == sorted(keys) and len(keys) == 1000


def test_entities_of_folders_stay_text(spark, tmp_path):
    rows = [("007", "a", "1"), ("1e3", "a", "2"), ("x/y=z w", "a", "3"), ("2024-01-01", "a", "4")]
    path = str(tmp_path / "documents")
    write_documents(ops.render_documents(spark.createDataFrame(rows, "entity string, key string, value string")), path)
    loaded = ops.load_documents(read_property_lines(spark, path)[0])
    assert sorted((r.entity, r.key, r.value) for r in loaded.collect()) == sorted(rows)


def test_lines_of_split_files_stay_in_order(spark, tmp_path):
    file = tmp_path / "large.conf"
    file.write_text("".join(f"k{i} {i}\n" for i in range(20000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in old:
            spark.conf.set(key, "20000")
        lines, _ = read_property_lines(spark, str(file))
        assert lines.rdd.getNumPartitions() > 3
        rows = ops.load_documents(lines).orderBy("part", "block_start", "line_id").collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert [r.value for r in rows] == [str(i) for i in range(20000)]
    assert rows[0].entity.endswith("large.conf")


def test_a_missing_path_costs_only_its_own_rows(spark, tmp_path):
    good = tmp_path / "a.properties"
    good.write_text("a=1\n\t\nb=2\n")
    missing = str(tmp_path / "none.properties")
    lines, unread = read_property_lines(spark, [str(good), missing])
    assert sorted((r.key, r.value) for r in ops.load_documents(lines).collect()) == [("a", "1"), ("b", "2")]
    assert [(r.path, r.reason) for r in unread.collect()] == [(missing, "not found")]
    lines, unread = read_property_lines(spark, missing)
    assert lines.columns == ["entity", "part", "block_start", "line_id", "line"]
    assert ops.load_documents(lines).count() == 0 and unread.count() == 1


def test_a_broken_file_is_not_shortened(spark, tmp_path):
    whole = gzip.compress("".join(f"k{i}={i}\n" for i in range(5000)).encode())
    (tmp_path / "x.gz").write_bytes(whole[: len(whole) // 2])
    lines, _ = read_property_lines(spark, str(tmp_path / "x.gz"))
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        lines.collect()
