"""Lines, repeated spans and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_rows import documents

from tiersmith.llm import common, line_dedup, run_index, simhash, span_dedup
from tiersmith.llm.components import components, stars
from tiersmith.llm.run_index import RunIndex

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def test_streams():
    texts = pa.array(["  Hello  World\n\n", None, "", " \t", "a", "b c\x0b D\nÉx"])
    data, offsets = common.token_stream(texts)
    rows = [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert rows == ["hello world\n", "\n", "\n", "\n", "a\n", "b c d Éx\n"]
    assert common.word_counts(texts).tolist() == [2, 0, 0, 0, 1, 4]
    data, lines = common.line_stream(texts)
    assert bytes(data).decode() == "Hello World\n\n\n" + "\n" * 3 + "a\n" + "b c D\nÉx\n" and lines.tolist() == [3, 1, 1, 1, 1, 2]


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(600, 600)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, *edges[:5], (None, 1)], "a long, b long")).collect()}
    want = {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = stars(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert dict(zip(a.tolist(), b.tolist())) == {k: v for k, v in want.items() if k != v}


def brute_lines(rows, min_words):
    lines = [(i, n, tuple(WORD.findall(x))) for i, t in sorted(rows) for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = set()
    for k, (i, n, w) in enumerate(lines):
        for _, _, v in lines[:k]:
            if v == w or (min(len(v), len(w)) >= min_words and line_dedup.within_one(list(v), list(w))):
                gone.add((i, n))
                break
    return gone


def line_rows():
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "dé"]
    rows = []
    for i in range(70):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 6, 7]))) for _ in range(rng.randint(0, 4))]
        rows.append((i * 2, "\n".join(lines)))
    return rows + [(1, None), (3, ""), (5, "\n\n"), (7, "x " * 3000 + "y"), (9, "x " * 3000 + "z"), (200, "  a\tb \r\n")]


def test_removed_lines(spark):
    rows = line_rows()
    got = {(r.doc_id, r.line) for r in line_dedup.removed_lines(documents(spark, rows, extra=["row", "line", "h1"]), min_words=5).collect()}
    assert got == brute_lines(rows, 5)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_drop_lines_with_ids_of_other_types(spark, kind):
    df = documents(spark, [(1, "one\ntwo"), (2, "two\nthree"), (None, "three")]).selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = line_dedup.drop_lines(df)
    assert out.schema == df.schema
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "one\ntwo"), ("2", ""), ("None", "three")]


def test_short_near_lines_go_by_default(spark):
    rng = random.Random(12)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(250)]
    rows = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(50)]
    rows += [(60, "it was a cold morning"), (61, "it was a warm morning"), (62, "it was a morning"), (63, "a cold morning"), (64, "a warm morning")]
    got = {(r.doc_id, r.line) for r in line_dedup.removed_lines(documents(spark, rows)).collect()}
    assert got == brute_lines(rows, line_dedup.MIN_WORDS)
    assert {(61, 0), (62, 0)} <= got and (64, 0) not in got


def test_drop_lines_keeps_rows_and_columns(spark):
    rows = [(2, "one\ntwo"), (1, "two"), (1, "two"), (None, "three"), (4, None), (5, "three\n\nfour")]
    df = documents(spark, rows, extra=["n_chars", "lines", "_gone_"])
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert got == [("1", "two", 3), ("1", "two", 3), ("2", "one", 3), ("4", None, 1), ("5", "\nfour", 5), ("None", "three", 5)]
    assert line_dedup.drop_lines(df.where("false")).count() == 0


def test_within_one():
    cases = {("a b", "a b"): True, ("a b", "a c"): True, ("a b", "b"): True, ("a b c", "b c a"): False, ("a", "b c"): False, ("a b", "b a"): False}
    for (x, y), want in cases.items():
        assert line_dedup.within_one(x.split(), y.split()) == line_dedup.within_one(y.split(), x.split()) == want


def test_run_index_against_all_substrings():
    rng = random.Random(5)
    for _ in range(150):
        length = rng.choice([2, 3, 5])
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        seen, want = set(), []
        for t in texts:
            for j in range(len(t) + 1):
                w = t[j : j + length]
                want.append(len(w) == length and w in seen)
                if len(w) == length:
                    seen.add(w)
        assert RunIndex(texts).repeated(length).tolist() == want


def test_runs_compress_copies():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(120))
    one, many = RunIndex([text]), RunIndex([text] * 50)
    assert many.n_runs < 2.5 * one.n_runs


def brute_spans(rows, length):
    seen, out = set(), []
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            w = t[j : j + length]
            if w in seen:
                gone[j : j + length] = True
            seen.add(w)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        n_spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block_bytes, many", [(1500, 4096), (1500, 1), (10**6, 4096)])
def test_removed_spans(spark, block_bytes, many):
    rng = random.Random(9)
    passage = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [passage(n) for n in (30, 99, 100, 150, 400)]
    rows = []
    for i in range(60):
        parts = [rng.choice([passage(rng.randint(0, 80)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 350), (503, "a" * 120), (504, rows[5][1]), (504, rows[6][1])]
    df = documents(spark, rows, extra=["block", "kind", "start"])
    got = span_dedup.remove_repeats(df, block_bytes=block_bytes, many=many)
    assert sorted(tuple(r) for r in got.collect()) == brute_spans(rows, 100)


def test_a_short_common_line_joins_no_runs():
    rng = random.Random(4)
    passage = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = passage(60)
    texts = [passage(150) + line + passage(150) for _ in range(200)]
    runs = span_dedup.Block(pa.table({"doc_id": pa.array(range(200), pa.int64()), "text": texts})).runs(100, 32)
    pairs = set(zip(runs.anchor.tolist(), runs.content.tolist()))
    assert len(pairs) == len({a for a, _ in pairs})  # no two different runs around one anchor: nothing to send on


@pytest.mark.parametrize("anchor", [1, 32, 99, 100])
def test_equal_windows_have_equal_anchors(anchor):
    rng = random.Random(3)
    line = bytes(rng.choice(b"ab") for _ in range(130))
    texts = [(b"x" * i + line + bytes(rng.choice(b"abc") for _ in range(i))).decode() for i in range(40)] + ["a" * 99, ""]
    block = span_dedup.Block(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    runs = block.runs(100, anchor)
    of_window, seen = {}, 0
    for doc, start, last, of_run in zip(runs.doc.tolist(), runs.start.tolist(), runs.last.tolist(), runs.anchor.tolist()):
        for at in range(start, last + 1):
            of_window.setdefault(block.texts[doc][at : at + 100], set()).add(of_run)
            seen += 1
    assert seen == sum(max(0, len(t) - 99) for t in texts) and all(len(a) == 1 for a in of_window.values())


def test_places_in_the_order_of_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 500):
        a = rng.integers(0, 9, n, dtype=np.uint64) << np.uint64(40) | rng.integers(0, 3, n, dtype=np.uint64)
        b = rng.integers(0, 3, n, dtype=np.uint64)
        assert span_dedup._order(a, b).tolist() == np.lexsort((b, a)).tolist()
        assert sorted(span_dedup._with_others(a).tolist()) == [i for i, x in enumerate(a) if (a == x).sum() > 1]


def test_messages_grow_with_the_blocks_and_not_much_faster():
    edges = span_dedup._edges(np.array([0, 1 << 46, (1 << 48) - 1], np.uint64), 48, 4)
    assert edges.tolist() == [0, 1, 2, 2, 3]
    assert [span_dedup._n_buckets(n) for n in (1, 10, 100, 128, 1000)] == [2, 20, 64, 64, 500]


def test_suffixes_in_order_with_and_without_room_in_the_keys(monkeypatch):
    rng = random.Random(7)
    texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 90))) for letters in (b"ab", b"\0\xff", bytes(range(256))) for _ in range(20)]
    texts += texts[:9]
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    want = [int(p) for _, _, p in sorted((t[i:], k, ends[k] - 1 - len(t) + i) for k, t in enumerate(texts) for i in range(len(t) + 1))]
    assert run_index.suffix_array(data, ends).tolist() == want
    numbered = run_index._numbered
    monkeypatch.setattr(run_index, "_numbered", lambda key, at, bits, _: numbered(key, at, bits, 64))
    assert run_index.suffix_array(data, ends).tolist() == want


def test_spans_of_nothing_and_of_twins(spark):
    assert span_dedup.remove_repeats(documents(spark, [])).count() == 0
    twins = span_dedup.remove_repeats(documents(spark, [(None, "x" * 50 + "y" * 60)] + [(1, "x" * 50 + "y" * 60)] * 2), keep_text=True).collect()
    assert sorted((str(r.doc_id), len(r.kept)) for r in twins) == [("1", 0), ("1", 0), ("None", 110)]


def brute_simhash(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(40, 140):
        words = rng.choice(base).split()
        if words:
            words[rng.randrange(len(words))] = "x"
        rows.append((i, " ".join(words).upper() if i % 2 else " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "long " * 4000)]
    out = simhash.simhash_components(documents(spark, rows, extra=["fingerprint", "key", "component"])).collect()
    prints = {i: brute_simhash(t) for i, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in out} == prints and all(len(r.fingerprint) == 16 for r in out)
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = {i: i for i in prints} | brute_components(links)
    assert {r.doc_id: r.component_id for r in out} == want
    kept = simhash.keep_first(documents(spark, rows)).collect()
    assert {r.doc_id for r in kept} == set(want.values())
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_ball_meets_every_close_pair():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = values.copy()
    for i in range(200):
        for b in rng.choice(64, i % 6, replace=False):
            near[i] ^= np.uint64(1 << int(b))
    every = np.unique(np.concatenate((values, near)))
    for radius in (0, 1, 2, 3):
        keys, place = simhash.variants(every, radius)
        a, b = simhash.close_pairs(keys, every[place], radius)
        distance = np.bitwise_count(every[:, None] ^ every[None, :])
        i, j = np.where((distance <= radius) & (distance > 0))
        x, y = stars(every[i], every[j])
        assert set(zip(a.tolist(), b.tolist())) == set(zip(x.tolist(), y.tolist()))
