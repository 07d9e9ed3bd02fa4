"""Orchard search and exact rounds against brute force."""

import hashlib

import numpy as np
import pytest

from tiersmith.llm import centroids


def brute(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return set()
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    total = sum(d for d, _ in found)
    return sorted(
        (i if i is not None else -1, c, d, sum(e for e, b in found if b == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, found, strict=True)
    )


def rows_of(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_orchard_equals_a_full_search(spread):
    rng = np.random.default_rng(spread)
    cents = rng.integers(-spread, spread + 1, size=(30, 3))
    cents[7] = cents[3]  # equal centroids
    vectors = rng.integers(-spread, spread + 1, size=(2_000, 3))
    squared = ((vectors[:, None] - cents[None]) ** 2).sum(axis=2)
    found, distance = centroids.Orchard(cents).nearest(vectors)
    assert np.array_equal(found, squared.argmin(axis=1)) and np.array_equal(distance, squared.min(axis=1))


def test_orchard_skips_what_is_far():
    rng = np.random.default_rng(0)
    cents = rng.integers(-(10**6), 10**6, size=(200, 4))
    vectors = np.repeat(cents, 5, axis=0) + rng.integers(-50, 50, size=(1_000, 4))
    lists = centroids.Orchard(cents)
    compared, plain = [], centroids._squared
    centroids._squared = lambda d: compared.append(len(d)) or plain(d)
    try:
        assert np.array_equal(lists.nearest(vectors)[0], np.repeat(np.arange(200), 5))
    finally:
        centroids._squared = plain
    assert sum(compared) < 0.5 * len(vectors) * len(cents)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 2)]) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[5][1]), (-4, [0.0] * 4)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None, 2.0, 3.0]), (504, [float("nan")] * 4), (505, [1.0, 2.0, float("-inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1L as cluster", "2L as distance", "'x' as v")
    assert rows_of(centroids.cluster(df, 12, 3, 4)) == brute(rows, 12, 3, 4)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [3.0, 1.0])]
    assert rows_of(centroids.cluster(spark.createDataFrame(rows, schema), 40, 5, 2)) == brute(rows, 40, 5, 2)
    empty = centroids.cluster(spark.createDataFrame([], schema), 40, 5, 2)
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0


def test_too_large_components_are_an_error():
    assert centroids.to_integers(np.array([[2.0**18, -0.001]]), 256).tolist() == [[2**26, -1]]
    with pytest.raises(ValueError, match="too large"):
        centroids.to_integers(np.array([[1e30, 0.0]]), 256)
