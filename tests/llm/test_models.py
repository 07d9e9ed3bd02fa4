"""Language-model scores against a plain trie, toxicity on held-out rows, trees and calibration."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import documents

from tiersmith.llm import exchange, ppm, toxicity, trees


def stream(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    return b" ".join(words) + b"\n", words


class Trie:
    """Prediction by partial matching with full exclusion, one byte at a time."""

    def __init__(self, texts, order):
        self.order, raw = order, defaultdict(lambda: defaultdict(int))
        for t in texts:
            data = b"\n" * order + stream(t)[0]
            for i in range(order, len(data)):
                for k in range(order + 1):
                    raw[data[i - k : i]][data[i]] += 1
        self.counts = {c: dict(n) for c, n in raw.items()}
        kinds = defaultdict(lambda: defaultdict(int))  # update exclusion between order 2 and the longest
        for c, n in raw.items():
            if 2 < len(c) <= order:
                for x in n:
                    kinds[c[1:]][x] += 1
        self.counts.update({c: dict(n) for c, n in kinds.items()})

    def log10(self, context, x):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            n = self.counts.get(context[len(context) - k :])
            if not n:
                continue
            total = sum(v for s, v in n.items() if s not in excluded)
            kinds = sum(s not in excluded for s in n)
            if x in n:
                return out + math.log10((n[x] - ppm.DISCOUNT) / total)
            if kinds:
                out += math.log10(ppm.DISCOUNT * kinds / total)
            excluded |= set(n)
        return out - math.log10(max(1, 256 - len(excluded)))

    def score(self, text):
        data = b"\n" * self.order + stream(text)[0]
        return sum(self.log10(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


def corpus():
    rng = random.Random(3)
    vocabulary = ["ab", "abc", "b", "Ca", "dé", "x", "abab", "zz"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    return list(enumerate([*texts, None, "", "  q  ", "new\nword", "long " * 3000]))


@pytest.mark.parametrize("block_bytes, fan", [(200, 3), (200, 1024), (10**6, 1024)])
def test_scores(spark, monkeypatch, block_bytes, fan):
    rows = corpus()
    monkeypatch.setattr(ppm, "ask", lambda *a: exchange.ask(*a, fan=fan))
    got = {r.doc_id: r for r in ppm.score(documents(spark, rows, extra=["block", "held", "kind"]), block_bytes=block_bytes).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    train = [t for i, t in rows if not held[i]]
    model, tokens = Trie(train, ppm.ORDER), defaultdict(int)
    for t in train:
        for w in [*stream(t)[1], None]:
            tokens[w] += 1
    n, v = sum(tokens.values()), len(tokens)
    for i, t in rows:
        r, own = got[i], [*stream(t)[1], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(w in tokens for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((tokens.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score == pytest.approx(model.score(t), rel=1e-5)


def test_scores_of_odd_tables(spark):
    assert ppm.score(documents(spark, [])).count() == 0
    rows = ppm.score(documents(spark, [(None, "a b"), (1, "a"), (1, "a")])).collect()
    assert len(rows) == 3 and all(r.score <= 0 for r in rows)
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = ppm.score(documents(spark, [(alone, "abc")])).collect()
    assert row.held_out and row.train_tokens == 0 and row.score == pytest.approx(-4 * math.log10(256))


def test_probabilities_of_a_context_sum_to_one():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd ") for _ in range(400)) + b"\n"
    seen = ppm.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    pairs = np.bincount(ppm.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 1).astype(np.int64), minlength=1 << 16).reshape(256, 256)
    for context in (b"\n\n\nab", data[50:55], b"zzzzz"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], dtype=np.uint64)
        keys = np.unique(np.concatenate((seen, asked)))
        u, c = np.unique(seen, return_counts=True)
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, u)] = c
        # complete for the two bytes before the last, as a bucket is
        p = 10 ** ppm.log_probabilities(keys, counts, pairs)[np.searchsorted(keys, asked)]
        assert p.sum() == pytest.approx(1)


def test_messages_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 1000).astype(np.uint64))
    assert np.array_equal(exchange.opened_keys(exchange.shut_keys(keys)), keys)
    assert len(exchange.opened_keys(exchange.shut_keys(keys[:0]))) == 0


def test_isotonic_curve_rises():
    rng = np.random.default_rng(2)
    x = rng.random(500)
    px, py = trees.isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(py) > 0).all() and (np.diff(px) > 0).all() and abs(np.interp(0.5, px, py) - 0.5) < 0.2


def test_equal_scores_are_one_point():
    y = np.array([0.0, 0.0, 1.0, 1.0])
    for order in ([0, 1, 2, 3], [2, 0, 3, 1]):
        px, py = trees.isotonic(np.full(4, 0.5), y[order])
        assert px.tolist() == [0.5] and py.tolist() == [0.5]
    px, py = trees.isotonic(np.array([0.1, 0.9, 0.9, 0.1, 0.5]), np.array([0, 1, 0, 0, 0.0]))
    assert py.tolist() == [0.0, 0.5] and px[-1] == pytest.approx(0.9)


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x = rng.integers(0, 6, size=(60, 3)).astype(float)
        y = (rng.random(60) < 0.2 + 0.1 * x[:, rng.integers(3)]).astype(float)
        p = y.mean()
        grad, hess = p - y, np.full(60, p * (1 - p))

        def gain(mask, g=grad, h=hess):
            return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (mask, ~mask)) - g.sum() ** 2 / (h.sum() + 1)

        best = max(gain(x[:, j] > c) for j in range(3) for c in range(5))
        model = trees.boost(x, y, trees=1, depth=1)
        feature, threshold = int(model.features[0][0]), model.thresholds[0][0]
        assert gain(x[:, feature] > threshold) == pytest.approx(best)


def test_a_few_labels_give_a_lexicon():
    toxic = Counter({f"rude{k}": 3 for k in range(6)} | {"the": 10, "odd": 3, "rare": 2})
    clean = Counter({"the": 58, "odd": 9})
    pairs = toxicity.rare_terms(toxic, clean)
    assert sorted(pairs) == [(3, 3)] * 6 + [(3, 12)]
    bound = toxicity.chance_bound([(3, 3)] * 6, {3: 200, 12: 50}, 10 / 68)
    assert bound == pytest.approx((10 / 68) ** 3)
    found = toxicity.make_lexicon(toxic, clean, 10, 58, bound)
    strong = toxicity.make_lexicon(Counter(rude0=9), Counter(), 10, 58)
    assert set(found) == {f"rude{k}" for k in range(6)} and 0 < found["rude0"] < strong["rude0"]
    assert not toxicity.make_lexicon(toxic, clean, 10, 58)
    assert toxicity.chance_bound([(3, 3)] * 6, {3: 10_000}, 10 / 68) < 0  # chance among so many
    assert toxicity.chance(3, 3, 0.5) == 0.125 and toxicity.chance(0, 4, 0.3) == pytest.approx(1)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = trees.boost(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def toxic_corpus():
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("lo", "ma", "ti", "ne") for b in ("ran", "sel", "dor", "vik", "pum")]
    rude = ["grumbag", "snotface", "dweebish"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs = documents(spark, [*rows, (5000, None), (5001, ""), (5002, "lo " * 20000 + "SNOTFACE!!")], extra=["_y", "x", "score"])
    truth = spark.createDataFrame([*labels, (3, None), (None, 1), (8, labels[4][1])], "doc_id long, toxic int")
    model = toxicity.fit(docs, truth)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [(y, out[i].predicted) for i, y in labels if out[i].held_out]
    assert len(held) > 40 and sum(y == p for y, p in held) / len(held) > 0.95
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert out[5000].score == out[5001].score < 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    for labels, want in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {want}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_lexicon_at_every_share_of_toxic_labels():
    for n_toxic, n_clean in ((110, 890), (330, 670), (500, 500), (800, 200)):
        found = toxicity.make_lexicon(Counter(rude=n_toxic // 2, plain=n_toxic), Counter(rude=1, plain=n_clean), n_toxic, n_clean)
        assert set(found) == {"rude"} and found["rude"] > 0


def test_disguised_words_and_second_person_are_seen():
    extract = toxicity.Extractor({"loser$": 5.0, "grumb": 4.0})
    x = extract(pa.array(["you l0s.er", "grumbling GRUMBAG!! at home", "nothing here", "", "looooser"]))
    assert x[:, 1].tolist() == [1, 2, 0, 0, 0] and x[0, 8] == 1 and x[0, 6] == 1 and x[1, 7] == 50
    assert x.shape == (5, toxicity.FEATURES) and np.isfinite(x).all()
