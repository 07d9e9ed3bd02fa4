import pytest

from tiersmith import operators as ops
from tiersmith.sources import read_state, write_state

STATE = "ns string, name string, payload string, owner string"


def frames(spark):
    desired = spark.createDataFrame(
        [("a", "new", "p1", 1), ("a", "new", "p2", 2), ("a", "same", "s", 1), ("a", "changed", "x", 1), ("a", "cleared", None, 1)],
        "ns string, name string, payload string, seq long",
    )
    existing = spark.createDataFrame(
        [("a", "same", "s", "me"), ("a", "changed", "y", "me"), ("a", "cleared", "z", "me"), ("b", "same", "q", "you")], STATE
    )
    return desired, existing


def test_plan(spark):
    desired, existing = frames(spark)
    plan = ops.upsert_plan(desired, existing, seq="seq")
    assert sorted((r.ns, r.name, r.action, r.payload) for r in plan.collect()) == [
        ("a", "changed", "update", "x"),
        ("a", "cleared", "update", None),
        ("a", "new", "create", "p2"),
        ("a", "same", "update", "s"),
    ]


def test_applying_twice_changes_nothing(spark):
    desired, existing = frames(spark)
    once = ops.apply_plan(ops.upsert_plan(desired, existing, seq="seq"), existing)
    want = {
        ("a", "same", "s", "me"),
        ("a", "changed", "x", "me"),
        ("a", "cleared", None, "me"),
        ("a", "new", "p2", None),
        ("b", "same", "q", "you"),
    }
    assert {tuple(r) for r in once.collect()} == want
    again = ops.upsert_plan(desired, once, seq="seq")
    assert {r.action for r in again.collect()} == {"update"}
    assert {tuple(r) for r in ops.apply_plan(again, once).collect()} == want


def test_the_last_complete_version_counts(spark, tmp_path):
    _, existing = frames(spark)
    path = str(tmp_path / "state")
    assert [write_state(existing, path, partitions=n) for n in (4, 3)] == [1, 2]
    assert sorted(tuple(r) for r in read_state(spark, path).collect()) == sorted(tuple(r) for r in existing.collect())
    # A state derived from the one that is there, and a write that did not end.
    fewer = read_state(spark, path).where("ns = 'a'")
    assert write_state(fewer, path) == 3
    (tmp_path / "state" / "version=4").mkdir()
    assert read_state(spark, path).count() == 3
    assert write_state(fewer.limit(1), path) == 5
    with pytest.raises(ValueError):
        read_state(spark, str(tmp_path / "none"))
