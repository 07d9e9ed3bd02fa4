import pytest

from tiersmith import operators as ops

MOUNT = "parent long, child long, ord long, name string, path string"
VOLUME = "parent long, name string"


def test_match_split_keeps_multiplicity(spark):
    mounts = spark.createDataFrame(
        [(1, "scratch-a", "/1"), (1, "scratch-a", "/2"), (1, "data", "/3"), (2, "scratch-a", "/4"), (1, "x-scratch-a", "/5")],
        "parent long, name string, path string",
    )
    volumes = spark.createDataFrame([(1, "scratch-a", "hostPath"), (1, "data", "emptyDir")], "parent long, name string, kind string")
    matched, residual = ops.match_split(mounts, volumes, "scratch-")
    assert sorted((r.path, r.kind) for r in matched.collect()) == [("/1", "hostPath"), ("/2", "hostPath")]
    assert sorted(r.path for r in residual.collect()) == ["/3", "/4", "/5"]
    special, rest = ops.split_volumes(volumes, "scratch-")
    assert [r.name for r in special.collect()] == ["scratch-a"] and [r.name for r in rest.collect()] == ["data"]


def lists_of(placed, cumulative):
    """The list of each child from the flat rows of its parent."""
    rows = placed.collect()
    children = {(r.parent, r.child): r.last_pos for r in ops.attached_children(placed).collect()}
    out = {}
    for parent, child in children:
        known = [r for r in rows if r.parent == parent and r.known]
        if cumulative:
            chosen = [r for r in known if r.pos <= children[(parent, child)]]
            out[(parent, child)] = [r.path for r in sorted(chosen, key=lambda r: r.pos)]
        else:
            parts = [[r for r in known if r.shared], [r for r in known if r.child == child]]
            out[(parent, child)] = [r.path for part in parts for r in sorted(part, key=lambda r: r.pos)]
    return out


def brute_lists(mounts, volumes, shared, cumulative):
    known = set(volumes)
    out = {}
    for parent in {m[0] for m in mounts}:
        head = [p for q, o, p in sorted(shared) if q == parent]
        running = list(head)
        for child in sorted({m[1] for m in mounts if m[0] == parent}):
            own = [m[4] for m in sorted(mounts) if m[:2] == (parent, child) and (parent, m[3]) in known]
            running = running + own
            out[(parent, child)] = list(running) if cumulative else head + own
    return out


def data():
    mounts = [(p, c, o, f"v{(p + c + o) % 4}", f"/{p}/{c}/{o}") for p in range(6) for c in range(5) for o in range(1 + (p * c) % 4)]
    volumes = [(p, f"v{k}") for p in range(6) for k in range(4) if (p + k) % 3]
    shared = [(p, o, f"/shared/{p}/{o}") for p in range(3) for o in range(p)]
    return mounts, volumes, shared


@pytest.mark.parametrize("cumulative", [True, False])
@pytest.mark.parametrize("with_shared", [True, False])
def test_lists_match_the_sequential_rule(spark, cumulative, with_shared):
    mounts, volumes, shared = data()
    shared = shared if with_shared else []
    parents = spark.createDataFrame([(p, o, "cfg", path) for p, o, path in shared], "parent long, ord long, name string, path string")
    placed = ops.attach_matching(
        spark.createDataFrame(mounts, MOUNT),
        # A volume given twice must not double a mount.
        spark.createDataFrame(volumes + volumes[:2], VOLUME),
        ["ord"],
        cumulative,
        parents if with_shared else None,
    )
    assert lists_of(placed, cumulative) == brute_lists(mounts, volumes, shared, cumulative)


def test_running_lists_of_a_large_parent_are_stored_once(spark):
    mounts = [(1, c, o, "v", f"/{c}/{o}") for c in range(60) for o in range(1 + c % 3 * 4)]
    placed = ops.attach_matching(
        spark.createDataFrame(mounts, MOUNT), spark.createDataFrame([(1, "v")], VOLUME), ["ord"], True, bucket_rows=16
    )
    assert placed.count() == len(mounts)
    assert lists_of(placed, True) == brute_lists(mounts, [(1, "v")], [], True)


def test_mounts_that_cannot_match_are_not_shuffled(spark):
    mounts = spark.createDataFrame([(1, "scratch-a", "/1"), (1, None, "/2"), (None, "data", "/3")], "parent long, name string, path string")
    volumes = spark.createDataFrame([(1, "scratch-a")], VOLUME)
    _, residual = ops.match_split(mounts, volumes, "scratch-")
    assert sorted(r.path for r in residual.collect()) == ["/2", "/3"]


def test_numbered_slots_and_lists(spark):
    df = spark.createDataFrame([(1, 3, "/c"), (1, 1, "/a"), (1, 2, "/a"), (2, 1, "/z")], "entity long, ord long, path string")
    rows, lists = ops.number_and_join(df, "path", ["ord"], "dir-")
    assert sorted((r.entity, r.pos, r.slot, r.path) for r in rows.collect()) == [
        (1, 1, "dir-1", "/a"),
        (1, 2, "dir-2", "/a"),
        (1, 3, "dir-3", "/c"),
        (2, 1, "dir-1", "/z"),
    ]
    assert {r.entity: (r.part, r.n_items, r.list) for r in lists.collect()} == {1: (0, 3, "/a,/a,/c"), 2: (0, 1, "/z")}
    _, parts = ops.number_and_join(df, "path", ["ord"], "dir-", part_rows=2)
    assert sorted((r.entity, r.part, r.list) for r in parts.collect()) == [(1, 0, "/a,/a"), (1, 1, "/c"), (2, 0, "/z")]


def test_select_named_or_all(spark):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "main"), (1, 3, "main"), (2, 1, "a"), (2, 2, "b"), (3, 1, None)],
        "parent long, pos long, name string",
    )
    got = sorted((r.parent, r.pos) for r in ops.select_named_or_all(df, "main").collect())
    assert got == [(1, 2), (2, 1), (2, 2), (3, 1)]
    for target in (None, ""):
        assert ops.select_named_or_all(df, target).count() == 6
