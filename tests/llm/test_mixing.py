"""Targets, quotas and repeatable draws of the mix."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersmith.llm import mixing

DOCS = "doc_id long, text string, source string, idx long, size long"


def rows():
    rng = np.random.default_rng(2)
    out = [(i, "w " * int(rng.integers(0, 40)), f"s{min(int(rng.geometric(0.3)), 9)}", 1, 1) for i in range(800)]
    return out + [(900, None, None, 1, 1), (901, "a b c", None, 1, 1), (902, "", "", 1, 1), (903, "x " * 300, "s1", 1, 1), (904, "q", "é", 1, 1), (905, "t t", "s1", 1, 1), (905, "t t", "s1", 1, 1)]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = goal - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    df = spark.createDataFrame(rows(), DOCS)
    out = mixing.mix(df, block_words=5_000, shard_words=4000)
    got = out.collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len((r.text or "").split())
        sizes[r.source] += r["size"]
    targets = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert len(r.shards) <= 2
        taken[r.source] += r["size"] * len(r.shards)
    assert all(abs(taken[s] - t) <= max(0.02 * t, 5) for s, t in targets.items())
    again = mixing.mix(df.repartition(7).orderBy(F.rand(3)), block_words=5_000, shard_words=4000)
    key = lambda r: (r.doc_id, str(r.text), r.shards)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    twins = [r.shards for r in got if r.doc_id == 905]
    assert twins[0] == twins[1]


def test_dealt_rows_have_places(spark):
    out = mixing.mix(spark.createDataFrame(rows(), DOCS), block_words=5_000, shard_words=4000)
    dealt = mixing.deal(out).collect()
    assert len(dealt) == sum(len(r.shards) for r in out.collect())
    places, words = defaultdict(list), Counter()
    for r in dealt:
        places[r.shard].append(r.position)
        words[r.shard] += r["size"]
    assert len(places) == 8 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_quotas_are_exact(spark):
    units = spark.createDataFrame([(0, 700), (1, 10), (2, 1), (3, 290)], "idx long, quota long")
    got = mixing.split_quotas(units, 3, 5).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.idx] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == {0: 700, 1: 10, 2: 1, 3: 290} and set(by_shard.values()) <= {125, 126}
    # hypergeometric: each shard's share of source 0 is near 70 %
    assert all(0.5 < r.quota / 125 < 0.9 for r in got if r.idx == 0)
    assert sorted(map(tuple, mixing.split_quotas(units.repartition(3), 3, 5).collect())) == sorted(map(tuple, got))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame(rows(), DOCS)
    assert mixing.mix(df.where("false")).count() == 0
    empty = mixing.mix(df.where("doc_id in (900, 902)")).collect()
    assert [(r.target, r["size"]) for r in empty] == [(0.0, 0)] * 2
