"""Token ids, token files and packing."""

import random
import zlib

import numpy as np
import pytest
from llm_rows import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tiersmith.llm import packing, token_store
from tiersmith.llm.common import kept_by, powers
from tiersmith.llm.tokens import Encoder, _apart, default_tokenizer, encoder

PATH = default_tokenizer()
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def raw(values):
    return np.array(values, dtype="<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\tab.,!'s é²٣中<|endoftext|>", max_size=30)), max_size=8))
def test_ids_equal_those_of_the_library(texts):
    assert ENCODER.encode(texts) == [raw(ids(t)) for t in texts]


def test_words_are_forgotten_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr("tiersmith.llm.tokens.KEEP_WORDS", 3)
    own = Encoder(PATH)
    texts = [f"one two{i} three{i}. four" for i in range(20)]
    assert [own.encode([t])[0] for t in texts] == [raw(ids(t)) for t in texts]


def test_bounds_of_memory_change_no_ids():
    own = Encoder(PATH, keep_words=5, take_chars=16)
    texts = [f"one two{i} three{i}. four " * 3 + "end" for i in range(20)]
    assert own.encode(texts) == [raw(ids(t)) for t in texts]
    assert own.encode(texts[::-1]) == [raw(ids(t)) for t in texts[::-1]] and len(own.words) < 60


LONG = "ofherithandaß çreelleÀÿĀɏ naïveñ Ciónja straße.. Œuvreî, łódźż"


def test_new_words_of_letters_need_no_search_for_pieces(monkeypatch):
    texts = [f"{LONG} {c}{LONG}\n{chr(0xC0 + i % 23)}{c * 3} x" for i, c in enumerate("ÀàßØøÿĀīłŒžǀɏaZ")]
    monkeypatch.setattr("tiersmith.llm.tokens.LEARN_WORDS", 7)
    own = Encoder(PATH)
    searched = []
    whole = own.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            searched.extend(texts)
            return whole(texts, add_special_tokens=add_special_tokens)

    own.tokenizer = Counted()
    assert own.encode(texts) == [raw(ids(t)) for t in texts]
    words = {w for t in searched for w in t.split(" ")[1:] if w.isalpha()}
    assert not words


def test_first_words_and_words_before_marks_need_no_search_for_pieces(monkeypatch):
    texts = [f"{c}one{i} Head{c}### {c}two***\n{c}Line$$$ it's' {c}last.\"" for i, c in enumerate("aàßøĀɏ")]
    own = Encoder(PATH)
    searched = []
    whole = own.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            searched.extend(texts)
            return whole(texts, add_special_tokens=add_special_tokens)

    own.tokenizer = Counted()
    assert own.encode(texts) == [raw(ids(t)) for t in texts]
    assert len(searched) == 2 and "#" not in "".join(searched) and "it's'" in "".join(searched)
    searched.clear()
    assert own.encode(texts[::-1]) == [raw(ids(t)) for t in texts[::-1]] and not searched


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr("tiersmith.llm.tokens.HASH_BYTES", 2)
    own = Encoder(PATH, keep_words=30)
    texts = [f"same{i} sane{i % 7} sad. sat\nsaw{i} sax" for i in range(40)]
    for _ in range(2):
        assert [own.encode([t])[0] for t in texts] == [raw(ids(t)) for t in texts]


def test_a_model_that_joins_letters_and_marks_searches_for_pieces():
    assert _apart({"merges": ["Ġ .", "Ġ a", "a b", "Ġa b"]})
    for merge in ("b .", "Ġa ,", "Ċ a", "Ã¤ ;"):
        assert not _apart({"merges": ["Ġ a", merge]})
    assert not _apart({"merges": [], "ignore_merges": True})
    own = Encoder(PATH)
    assert own.by_letters
    own.by_letters = False
    texts = ["one two, three.\nfour ä!", " five\nsix", "\tseven eight"]
    assert own.encode(texts) == [raw(ids(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZàÀßñÿøØĀɏłŒ×÷ƛªº .\n\t\u00a0\x85\x1c\u3000", max_size=40), max_size=6))
def test_letters_and_white_space_equal_the_library(texts):
    assert ENCODER.encode(texts) == [raw(ids(t)) for t in texts]


TEXTS = [None, "", " ", "a", "Hello world. " * 500, "x <|endoftext|> y", "dé 中文  two\n\nlines", "Hello world. " * 500]


def test_store_round_trip(spark, tmp_path):
    rows = [(7 * i % 11, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (3, "twin"), (3, "twin")]
    df = documents(spark, rows, extra=["part", "start", "ids", "n_tokens"])
    path = str(tmp_path / "store")
    token_store.write_store(token_store.encode_documents(df, PATH, 0, part_bytes=2000), path)
    got = [tuple(r) for r in token_store.checked_tokens(spark, path).collect()]
    want = sorted(((d is not None, d), raw([*ids(t), 0])) for d, t in rows)
    start = 0
    by_start = sorted(got, key=lambda r: r[1])
    assert [(r[0] is not None, r[0]) for r in by_start] == [k for k, _ in want]
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(d), len(x) // 4, zlib.crc32(x)) for (_, d), x in want)
    for _, first, n, _ in by_start:
        assert first == start
        start += n
    meta = token_store.read_metadata(spark, path)
    assert "ids#" not in meta._jdf.queryExecution().executedPlan().toString()
    some = token_store.read_tokens(spark, path, 2, 5).collect()
    assert sorted(r.doc_id for r in some) == sorted(d for d, _ in rows if d is not None and 2 <= d <= 5)
    assert {(r.doc_id, r.start) for r in some} <= {(r[0], r[1]) for r in got}


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(token_store.encode_documents(documents(spark, []), PATH, 0), path)
    assert token_store.checked_tokens(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plan_uses_each_length_once(histogram):
    plan = packing.plan(histogram, 64)
    used = {}
    for lengths, copies in plan:
        assert sum(lengths) <= 64 and copies > 0
        for x in lengths:
            used[x] = used.get(x, 0) + copies
    assert used == {x: n for x, n in histogram.items() if n}


def test_fullest_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 40)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        chosen = packing.fullest({x: items.count(x) for x in items}, room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(x) <= items.count(x) for x in chosen)


def test_packed_documents(spark):
    rows = [(i, "word " * (i * 37 % 90)) for i in range(60)] + [(100, None), (101, ""), (102, "long " * 700), (5, "twin"), (5, "twin")]
    out = packing.pack_documents(documents(spark, rows, extra=["sequence_id", "length"]), PATH, 2, 128).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        own = [*ids(text), 2]
        found = sorted(by_doc[doc], key=lambda r: r.piece)
        if doc == 5:
            continue
        at = 0
        for k, r in enumerate(found):
            assert (r.piece, r.start) == (k, at) and r.length <= 128 and (k == 0 or r.length == 128)
            assert r.ids_crc32 == zlib.crc32(raw(own[at : at + r.length]))
            at += r.length
        assert at == len(own)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.1 * -(-sum(r.length for r in out) // 128)


def test_packing_spreads_a_hot_length(spark):
    items = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 7, id % 10 + 1) as length")
    out = packing.pack(items, 10, rank_rows=50).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 1000
    assert packing.pack(items.where("id < 0"), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items.selectExpr("id", "cast(null as int) as length"), 10)


def test_a_worker_keeps_what_one_operator_needs():
    own = encoder(PATH, 10)
    assert encoder(PATH, 10) is own and kept_by("tokens") == {(PATH, 10, None): own}
    powers(100)
    assert kept_by("tokens") and len(powers(1)[0]) >= 100
    assert kept_by("another") == {} and encoder(PATH, 10) is not own
