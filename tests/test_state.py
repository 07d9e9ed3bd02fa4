"""States that are kept: null keys, buckets, maintained settings."""

import random

import pytest
from pyspark.sql import functions as F

from tiersmith import operators as ops
from tiersmith.sources import create_buckets, read_buckets, update_buckets, upsert_buckets, vacuum_buckets
from tiersmith.sources.buckets import _BUCKET, bucket_of, manifest

STATE = "ns string, name string, payload string"
NULLS = [(None, "a", "o"), ("n", None, "p"), (None, None, "q"), ("n", "a", "r")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_keys_meet(spark):
    existing = spark.createDataFrame(NULLS, STATE).withColumn("note", F.col("payload"))
    desired = spark.createDataFrame([(None, "a", "O"), (None, None, "Q"), ("m", None, "new"), ("n", "a", None)], STATE)
    plan = ops.upsert_plan(desired, existing)
    assert {(r.ns, r.name): r.action for r in plan.collect()} == {(None, "a"): "update", (None, None): "update", ("m", None): "create", ("n", "a"): "update"}
    want = sorted([(None, "a", "O", "o"), ("n", None, "p", "p"), (None, None, "Q", "q"), ("n", "a", None, "r"), ("m", None, "new", None)], key=repr)
    once = ops.apply_plan(plan, existing)
    assert rows_of(once) == want
    again = ops.upsert_plan(desired, once)
    assert {r.action for r in again.collect()} == {"update"} and rows_of(ops.apply_plan(again, once)) == want
    both = ops.reconcile(desired, existing)
    assert rows_of(both.select(*existing.columns)) == want
    assert sorted(r._ts_action or "" for r in both.collect()) == ["", "create", "update", "update", "update"]


def test_repeated_desired_null_keys_take_the_last(spark):
    desired = spark.createDataFrame([(None, "a", "1", 1), (None, "a", "2", 2)], f"{STATE}, seq long")
    assert rows_of(ops.upsert_plan(desired, spark.createDataFrame(NULLS, STATE), seq="seq")) == [(None, "a", "update", "2")]


def files_below(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (path / "data").rglob("part-*.parquet")}


def big_state(spark, n=2_000):
    return spark.range(n).selectExpr("cast(id % 17 as string) as ns", "concat('job-', id) as name", "'old' as payload", "id as note")


def test_an_upsert_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "state")
    state = big_state(spark)
    assert create_buckets(state, path, buckets=64) == 1
    before = files_below(tmp_path / "state")
    desired = state.where("note % 100 = 0").selectExpr("ns", "name", "'new' as payload").limit(20)
    hit = {r[0] for r in desired.select(bucket_of(["ns", "name"], 64)).distinct().collect()}
    assert upsert_buckets(desired, path) == 2
    after = files_below(tmp_path / "state")
    assert {k: v for k, v in after.items() if k in before} == before  # nothing that was there is touched
    assert {int(k.split(f"{_BUCKET}=")[1].split("/")[0]) for k in after.keys() - before.keys()} == hit and len(hit) < 25
    want = rows_of(ops.apply_plan(desired, state))
    assert rows_of(read_buckets(spark, path)) == want
    assert upsert_buckets(desired, path) == 3 and rows_of(read_buckets(spark, path)) == want
    assert rows_of(read_buckets(spark, path, 1)) == rows_of(state)


def test_a_write_that_did_not_end_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    state = spark.createDataFrame(NULLS, STATE)
    create_buckets(state, path, buckets=4)
    desired = spark.createDataFrame([(None, "a", "new"), ("x", "y", "z")], STATE)

    def broken(old, new):
        return old.withColumn("payload", F.when(F.lit(True), F.raise_error(F.lit("lost"))).cast("string"))

    with pytest.raises(Exception, match="lost"):
        update_buckets(desired, path, broken)
    assert rows_of(read_buckets(spark, path)) == rows_of(state) and manifest(spark, path).version == 1
    (tmp_path / "state" / "data" / "version=7" / f"{_BUCKET}=0").mkdir(parents=True)
    (tmp_path / "state" / "manifests" / "0000000009.json.tmp").write_text("{")
    assert upsert_buckets(desired, path) == 8
    assert rows_of(read_buckets(spark, path)) == sorted([(None, "a", "new"), *NULLS[1:], ("x", "y", "z")], key=repr)


def test_buckets_that_become_empty_new_ones_and_no_changes(spark, tmp_path):
    path = str(tmp_path / "state")
    create_buckets(big_state(spark, 40), path, buckets=8)
    gone = spark.createDataFrame([("3", "job-3")], "ns string, name string")
    update_buckets(gone, path, lambda old, new: old.join(new, ["ns", "name"], "left_anti").where("1 = 0"))
    left = read_buckets(spark, path)
    assert 0 < left.count() < 40 and left.where("name = 'job-3'").count() == 0
    before = rows_of(left)
    assert update_buckets(gone.limit(0), path, lambda old, new: old) == 3 and rows_of(read_buckets(spark, path)) == before
    upsert_buckets(spark.createDataFrame([("3", "job-3", "back")], STATE), path)
    assert ("3", "job-3", "back", None) in rows_of(read_buckets(spark, path))
    empty = str(tmp_path / "empty")
    create_buckets(spark.createDataFrame([], STATE), empty, buckets=4)
    assert read_buckets(spark, empty).count() == 0
    upsert_buckets(spark.createDataFrame(NULLS, STATE), empty)
    assert rows_of(read_buckets(spark, empty)) == sorted(NULLS, key=repr)


def test_errors_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "state")
    with pytest.raises(ValueError, match="no complete state"):
        read_buckets(spark, path)
    create_buckets(spark.createDataFrame(NULLS, STATE), path, buckets=2)
    with pytest.raises(ValueError, match="there is a state"):
        create_buckets(spark.createDataFrame(NULLS, STATE), path)
    with pytest.raises(ValueError, match="must not change keys"):
        update_buckets(spark.createDataFrame(NULLS[:1], STATE), path, lambda old, new: spark.range(50).selectExpr("string(id) as ns", "'k' as name", "'' as payload"))
    for _ in range(2):
        upsert_buckets(spark.createDataFrame(NULLS, STATE), path)
    want = rows_of(read_buckets(spark, path))
    assert len(vacuum_buckets(spark, path)) == 3 and rows_of(read_buckets(spark, path)) == want
    with pytest.raises(ValueError, match="no version 1"):
        read_buckets(spark, path, 1)


def random_log(rng, n):
    return [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice(["x", "", None, "z"]), rng.choice(["spec", "conf"]), rng.randrange(25)) for _ in range(n)]


LOG = "entity long, key string, value string, layer string, seq long"


@pytest.mark.parametrize("presence", ["non_empty", "not_null", "key_exists"])
@pytest.mark.parametrize("seed", range(3))
def test_a_merged_state_is_a_full_recompute(spark, presence, seed):
    rng = random.Random(seed)
    old, late = random_log(rng, 60), random_log(rng, 20)
    people = spark.createDataFrame([(1,), (2,), (3,), (None,)], "entity long")
    state = ops.settings_state(spark.createDataFrame(old, LOG))
    for batch in (late, late[:10], old[:5]):  # late writes, and writes that come again
        state = ops.merge_settings(state, spark.createDataFrame(batch, LOG))
    whole = spark.createDataFrame(old + late, LOG)
    args = (["spec", "conf"], people, {"a": "0", "b": None}, presence)
    assert rows_of(ops.resolve_layers(ops.state_writes(state), *args)) == rows_of(ops.resolve_layers(whole, *args))
    assert rows_of(state) == rows_of(ops.settings_state(whole))
    assert rows_of(ops.latest_setting(ops.state_writes(state))) == rows_of(ops.latest_setting(whole))


def test_an_empty_state(spark):
    state = ops.settings_state(spark.createDataFrame([], LOG))
    assert state.count() == 0 and ops.state_writes(state).count() == 0
    assert ops.merge_settings(state, spark.createDataFrame([(1, "a", "x", "spec", 1)], LOG)).count() == 1
