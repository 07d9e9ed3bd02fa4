"""Pivot indexes against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tiersmith.llm import ann, embedding_dedup
from tiersmith.llm.components import stars

SCHEMA = "vec_id long, embedding array<float>, label int, pivot int, class long"


def vectors(n=400, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 2, n):  # near copies of the first half, of different closeness
        x[i] = x[i - n // 2] + rng.normal(size=dim) * rng.choice([0.01, 0.2, 0.4])
    x[5:30] = x[4] + rng.normal(size=(25, dim)) * 0.02
    return x.astype(np.float32)


ODD = [None, [], [0.0] * 24, [1.0] * 23 + [None], [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23]


def frame(spark, x, labels):
    rows = [(i, v.tolist(), labels[i], 0, 0) for i, v in enumerate(x)]
    rows += [(1000 + i, v, 1, 0, 0) for i, v in enumerate(ODD)]
    rows += [(2000, x[0].tolist(), None, 0, 0), (2001, x[0].tolist(), None, 0, 0), (2002, x[4].tolist(), labels[4], 0, 0), (2003, [1.0, 2.0], 1, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_links_and_groups(spark):
    x = vectors()
    labels = [i % 3 if not 4 <= i < 30 else 1 for i in range(len(x))]
    df = frame(spark, x, labels)
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df, 0.93, chunk=40).collect()}
    assert len(got) == df.count()
    ids = [*range(len(x)), 2002]
    rows = np.concatenate((x, x[4:5])).astype(np.float64)
    own = np.array([*labels, labels[4]])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (own[:, None] == own[None, :])
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.97 * near.sum() and all(got[i].n_links <= n for i, n in zip(ids, near.sum(axis=1)))
    a, b = np.nonzero(near)
    p, q = stars(np.array(ids)[a], np.array(ids)[b])
    want = dict(zip(p.tolist(), q.tolist()))
    assert np.mean([got[i].component_id == want.get(i, i) for i in ids]) > 0.98
    for i in [1000 + k for k in range(len(ODD))] + [2000, 2001, 2003]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert embedding_dedup.near_embeddings(df.where("false")).count() == 0


def test_chunks_change_nothing(spark):
    x = vectors(120)
    df = frame(spark, x, [0] * len(x))
    one, many = (sorted(tuple(r) for r in embedding_dedup.near_embeddings(df, 0.9, chunk=c).collect()) for c in (10_000, 7))
    assert one == many


def crowd(n, dim, cosine, rng):
    """Vectors of about this cosine with each other, none equal."""
    return rng.normal(size=dim) / np.sqrt(dim) + rng.normal(size=(n, dim)) * np.sqrt((1 / cosine - 1) / dim)


def test_links_of_a_crowd_are_found(spark):
    rng = np.random.default_rng(6)
    for cosine in (0.94, 0.97):
        x = np.concatenate((crowd(600, 64, cosine, rng), rng.normal(size=(1200, 64)))).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)], SCHEMA).repartition(4)
        unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        near = (unit @ unit.T >= 0.93).sum() - len(x)
        got = embedding_dedup.near_embeddings(df, 0.93).agg(F.sum("n_links"), F.count_if("kept")).first()
        assert 0.99 * near <= got[0] <= near and got[1] == 1201


def exact(x, ids, q, k):
    score = x @ x[q]
    order = sorted((i for i in range(len(x)) if ids[i] != ids[q]), key=lambda i: (-score[i], ids[i]))
    return [ids[i] for i in order[:k]]


def test_search_is_exact_over_all_and_good_over_a_part(spark):
    x = (vectors(600, seed=7) * np.random.default_rng(1).uniform(0.3, 2, (600, 1))).astype(np.float32)
    df = frame(spark, x, [0] * len(x))
    ids = [*range(len(x)), 2000, 2001, 2002]
    rows = np.concatenate((x, x[[0, 0, 4]])).astype(np.float64)
    for settings, least in (({"part": 1.0, "shard_rows": 100, "block_rows": 5}, 1.0), ({"part": 0.4, "least": 50, "n_pivots": 64, "prefix": 32}, 0.9)):
        got = {}
        for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, **settings).collect():
            got.setdefault(r.query_id, []).append(r)
        assert set(got) == {i for i in ids if i % 20 == 0}
        hits = 0
        for q, found in got.items():
            found.sort(key=lambda r: r.rank)
            assert [r.rank for r in found] == list(range(1, 21))
            want = exact(rows, ids, ids.index(q), 20)
            hits += len(set(want) & {r.vec_id for r in found})
            if least == 1:
                assert [r.vec_id for r in found] == want
            assert all(abs(r.score - rows[ids.index(r.vec_id)] @ rows[ids.index(q)]) < 1e-9 for r in found)
        assert hits >= least * 20 * len(got)


def test_search_among_many_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 32)) * 0.5
    copies = sorted(rng.permutation(1500)[:500].tolist())
    x[copies] = x[0] * 2  # longer than the others: the copies are nearest to each other
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)], SCHEMA).repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, least=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    rows = x.astype(np.float64)
    hits = [len(set(exact(rows, range(len(x)), q, 20)) & set(got[q])) for q in got if q not in copies]
    assert len(got) == 75 and 30 < len(hits) < 70 and np.mean(hits) >= 0.95 * 20
    for q in set(got) & set(copies):
        assert got[q] == [i for i in copies if i != q][:20]


def test_search_of_repeated_rows(spark):
    x = vectors(200, seed=9)
    df = frame(spark, x, [0] * len(x))
    again = df.union(df.where("vec_id % 20 = 0")).union(df.where("vec_id % 7 = 0"))
    once, more = (sorted(tuple(r) for r in ann.search(d, F.col("vec_id") % 20 == 0, 20, part=1.0, shard_rows=60).collect()) for d in (df, again))
    assert [r[:3] for r in once] == [r[:3] for r in more]
    assert np.allclose([r[3] for r in once], [r[3] for r in more])
    shared = df.union(df.where("vec_id = 20").selectExpr("vec_id", "transform(embedding, x -> cast(-x as float))", "label", "pivot", "class"))
    got = ann.search(shared, F.col("vec_id") == 20, 20, part=1.0).collect()
    assert sorted(r.rank for r in got) == sorted([*range(1, 21)] * 2) and all(r.vec_id != 20 for r in got)


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 0, 0), (1, [0.5, 0.0], 1, 0, 0), (2, [0.5, 0.0], 1, 0, 0), (None, [9.0, 9.0], 1, 0, 0)], SCHEMA)
    got = ann.search(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.where("false"), F.col("vec_id") == 0, 20).count() == 0
    assert ann.search(df, F.col("vec_id") == 7, 20).count() == 0


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(3)
    n, n_pivots, length = 50, 12, 5
    orders = np.stack([rng.permutation(n_pivots)[:length] for _ in range(n)])
    place = lambda o: [int(np.flatnonzero(o == p)[0]) if p in o else length for p in range(n_pivots)]
    distance = [sum(abs(a - b) for a, b in zip(place(orders[0]), place(o))) for o in orders]
    saved = ann.footrule_savings(orders[0], ann.inverted_files(orders, n_pivots), n)
    assert [length * (length + 1) - 2 * s for s in saved.tolist()] == distance
