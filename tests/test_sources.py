"""Packed documents, broken files, counts in one pass."""

import gzip

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tiersmith import operators as ops
from tiersmith.sources import read_compressed_lines, read_document, read_packed, write_packed


def rows_scanned(spark, path, entity):
    """Rows that the scan for an entity puts out, after row groups and pages were skipped."""
    df = read_packed(spark, path).where(F.col("entity") == entity)  # the filter of ``read_document``, without its sort
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


@pytest.fixture
def packed(spark, tmp_path):
    documents = spark.range(0, 60_000, 1, 6).selectExpr(
        "concat('entity-', cast(id div 2 as string)) as entity", "cast(id % 2 as int) as part", "1L as n_lines", "concat('k=', id, '\\n') as document"
    )
    documents = documents.unionByName(documents.limit(1).selectExpr("cast(null as string) as entity", "0 as part", "n_lines", "'none' as document"))
    path = str(tmp_path / "packed")
    write_packed(documents, path, files=3, row_group_bytes=64 << 10, page_rows=500, expected=5_000)
    return documents, path


def test_one_entity_is_read_without_the_others(spark, packed):
    documents, path = packed
    found = read_document(spark, path, "entity-12345")
    assert [(r.part, r.document) for r in found.collect()] == [(0, "k=24690\n"), (1, "k=24691\n")]
    assert rows_scanned(spark, path, "entity-12345") < 3_000
    inside = read_document(spark, path, "entity-12345x")  # within the range of a file, but in none
    assert inside.count() == 0 and rows_scanned(spark, path, "entity-12345x") < 3_000
    assert [r.document for r in read_document(spark, path, None).collect()] == ["none"]
    assert read_packed(spark, path).exceptAll(documents).count() == 0 and read_packed(spark, path).count() == 60_001


def test_a_large_entity_lies_in_several_files(spark, tmp_path):
    documents = spark.range(9_000).selectExpr("'hot' as entity", "cast(id as int) as part", "1L as n_lines", "string(id) as document")
    path = str(tmp_path / "hot")
    write_packed(documents, path, files=4)
    rows = read_document(spark, path, "hot")
    assert [r.part for r in rows.collect()] == list(range(9_000))
    assert spark.read.parquet(path).selectExpr("_metadata.file_path").distinct().count() == 4


def test_a_broken_file_costs_its_own_rows_only(spark, tmp_path):
    for name, lines in (("a", ["x=1", "y=2", ""]), ("b", [f"k{i}=é{i}" for i in range(30_000)]), ("c", ["z=3"]), ("d", [])):
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress("".join(line + "\n" for line in lines).encode()))
    whole = (tmp_path / "c.gz").read_bytes()
    (tmp_path / "cut.gz").write_bytes((tmp_path / "b.gz").read_bytes()[:20_000])
    (tmp_path / "latin.gz").write_bytes(gzip.compress("k=é\n".encode("latin-1")))
    (tmp_path / "none.gz").write_bytes(b"k=v\n")
    (tmp_path / "sum.gz").write_bytes(whole[:-8] + b"\0\0\0\0" + whole[-4:])
    lines, broken = read_compressed_lines(spark, str(tmp_path))
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in broken.collect()}
    assert set(reasons) == {"cut.gz", "latin.gz", "none.gz", "sum.gz"} and "EOFError" in reasons["cut.gz"]
    by_file = {}
    for r in sorted(lines.collect(), key=lambda r: (r.entity, r.line_id)):
        by_file.setdefault(r.entity.rsplit("/", 1)[1], []).append(r.line)
    assert {k: len(v) for k, v in by_file.items()} == {"a.gz": 3, "b.gz": 30_000, "c.gz": 1}
    assert by_file["a.gz"] == ["x=1", "y=2", ""] and by_file["b.gz"][-1] == "k29999=é29999"
    loaded = {(r.key, r.value) for r in ops.load_documents(lines).where("key in ('x', 'z', 'k7')").collect()}
    assert loaded == {("x", "1"), ("z", "3"), ("k7", "é7")}


@pytest.mark.parametrize("policy", ["default", "quarantine"])
def test_counts_come_with_the_rows(spark, policy):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("",), ("7",), (" 3",)], "port string")
    seen = Observation()
    good, bad = ops.parse_or_quarantine(df, "port", 9, policy, observation=seen)
    assert len(good.collect()) == (6 if policy == "default" else 3)
    assert seen.get == {"n_rows": 6, "n_absent": 1, "n_malformed": 3} and bad.count() == 3
