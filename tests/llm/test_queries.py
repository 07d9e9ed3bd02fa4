"""The registered queries run over whole tables, and the pipeline does what its stages say."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest
from oracle import assert_same, duck

import __spark_entry__ as entry_point
import corpus_pipeline
from tiersmith.llm.queries import ORACLE_SQL, QUERIES


def test_all_operators_are_registered():
    names = entry_point.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op11_spelling_variants"}))  # its rows are words
def test_query_covers_its_table(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    source, key = ("embeddings", "vec_id") if name.startswith(("op2_", "op10_", "op12_")) else ("documents", "doc_id")
    if name.startswith("op13_"):
        source, key = "conversations", "conv_id"
    ids = {r[0] for r in duckdb.sql(f"select {key} from '{sf_dir}/{source}.parquet'").fetchall()}
    if name.startswith("op10_"):
        assert {r.query_id for r in rows} == {i for i in ids if i % 20 == 0}
    else:
        assert {r[key] for r in rows} == ids | ({-7} if source == "conversations" else set())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, sf_dir, name):
    assert assert_same(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name]) > 0


def test_the_mix_is_dealt_to_shards(spark, sf_dir):
    runs = [QUERIES["op6_source_mix"](spark, sf_dir).collect() for _ in range(2)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    shards = {}
    for r in runs[0]:
        places = [tuple(map(int, p.split(":"))) for p in (r.places or "").split()]
        assert r.taken == r["size"] * len(places) and len(places) <= 2
        for shard, position in places:
            shards.setdefault(shard, []).append((position, r["size"]))
    assert len(shards) == 8  # each place is taken once, and the shards are about equal
    assert all(sorted(p for p, _ in own) == list(range(len(own))) for own in shards.values())
    words = [sum(n for _, n in own) for own in shards.values()]
    assert max(words) < 2 * sum(words) / 8


def test_results_stay_when_a_query_runs_again(spark, sf_dir):
    first = QUERIES["op3_token_store"](spark, sf_dir)
    QUERIES["op3_token_store"](spark, sf_dir)
    assert first.count() == 200


def test_stages_take_clashing_names_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for name in ("size", "shards", "shard", "copy", "_key", "_doc", "_row", "_gone", "_first", "_idx", "_b", "_units", "_source", "c0"):
        docs = docs.selectExpr("*", f"'{name}' as `{name}`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {tuple(r[5:]) for r in out.collect()} == {tuple(docs.columns[5:])}
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 40


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["drop_toxic", "drop_lines", "drop_near_copies", "mix_sources", "pack_sequences"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir).checkpoint()
        assert out.columns == docs.columns
        if name == "drop_lines":
            assert out.count() == kept.count()
        elif name != "mix_sources":
            assert out.count() < kept.count() and out.exceptAll(kept).count() == 0
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    )


def test_stages_leave_room_for_the_next(spark, sf_dir, tmp_path, monkeypatch):
    """A task holds a row group of the table between two stages, so that has a bound of its own; workers give freed arrays back."""
    monkeypatch.setattr(corpus_pipeline, "ROW_GROUP_BYTES", 256 << 10)
    text = "concat_ws(' ', sha2(string(id), 512), sha2(string(-id), 512), sha2(string(id + 0.5), 512), sha2(string(id / 7), 512))"
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", f"{text} as text", "'a' as source")
    before = spark.conf.get("parquet.block.size", None)
    try:
        corpus_pipeline.drop_near_copies(spark, docs, sf_dir).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("parquet.block.size", before) if before else spark.conf.unset("parquet.block.size")
    files = [pq.ParquetFile(f).metadata for f in sorted(tmp_path.glob("out/*.parquet"))]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 4000
    assert max(g.total_byte_size for g in groups) < 1 << 20

    def found(batches):
        for batch in batches:
            yield batch.assign(x=os.environ.get("MALLOC_MMAP_THRESHOLD_"))[["x"]]

    assert [r.x for r in spark.range(1).mapInPandas(found, "x string").collect()] == [str(1 << 20)]
