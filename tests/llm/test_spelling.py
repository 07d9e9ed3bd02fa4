"""Spelling variants against brute force, on words made to be near each other."""

import itertools
import random
import zlib
from collections import Counter

import pytest
from llm_rows import documents

from tiersmith.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, drop_mod=199):
    lower = {c: c + 32 for c in range(65, 91)}
    out = Counter()
    for doc_id, text in rows:
        for letter, run in itertools.groupby(text or "", lambda c: ("a" <= c <= "z") or ("A" <= c <= "Z") or "À" <= c <= "ÿ"):
            word = "".join(run).translate(lower)
            if not letter:
                continue
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % drop_mod == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6}


def brute(words, min_n=5, factor=5):
    words = {w: n for w, n in words.items() if n >= min_n}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(6, 10))) for _ in range(25)]
    words = []
    for stem in stems:
        n = rng.choice([40, 200])
        words += [stem] * n
        for _ in range(6):
            at, kind = rng.randrange(len(stem)), rng.randrange(3)
            near = stem[:at] + ["", rng.choice("abé"), rng.choice("abé") + stem[at]][kind] + stem[at + 1 :]
            words += [near if rng.random() < 0.5 else near.replace("a", "A")] * rng.choice([3, 6, 30])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::60])) for i in range(60)]
    want = brute(brute_words(rows, 7))
    assert sum(r[1] is not None for r in want) > 10 and any(r[2] != r[1] and r[1] for r in want)
    assert rows_of(spelling.variants(documents(spark, rows, ["word", "n", "wid", "node"]), drop_mod=7)) == want


def test_edits_at_every_place_and_repeated_letters(spark):
    base = ["aabbcc", "abbbbbc", "zzzzzz", "zzzzzzz", "abcdefghij"]
    words = {w for b in base for i in range(len(b) + 1) for w in (b, b[:i] + "b" + b[i:], b[:i] + b[i + 1 :], b[:i] + "y" + b[i + 1 :])}
    counts = {w: 5 + k for k, w in enumerate(sorted(w for w in words if len(w) >= 6))}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_words(table).collect()}
    assert got == {(a, b) for a in counts for b in counts if one_edit(a, b)}


def test_long_words_and_pieces(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcde") for _ in range(30_000))
    rows = [(1, " ".join([long] * 30)), (2, " ".join([long[:17_000] + "x" + long[17_000:], long[:-1], long[1:]] * 5)), (3, "a" * 20 + " " + "a" * 21)]
    got = rows_of(spelling.variants(documents(spark, rows), drop_mod=1 << 33))
    want = brute(brute_words(rows, 1 << 33))
    assert got == want and len(want) == 4 and sum(r[1] == long for r in want) == 3
    text = "ab " * 5_000 + "c" * 40 + " d"
    spans = list(spelling.text_pieces(text, 1_000))
    assert "".join(text[a:b] for a, b in spans) == text and all(not (text[b - 1] + text[b]).isalpha() for _, b in spans[:-1])


def test_nested_words_take_many_levels(spark):
    counts = {"a" * k: 5 * k for k in range(6, 60)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_words(table).collect()}
    assert got == {(a, b) for a in counts for b in counts if one_edit(a, b)}


def test_forms_lead_to_the_last(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("v", "w3")]
    got = {tuple(r) for r in spelling.last_forms(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {(w, "w11") for w, _ in forms}


def test_nulls_and_empty_tables(spark):
    rows = [(None, "wordings " * 5), (None, None), (1, ""), (1, "wordings " * 5), (1, "wordings " * 5)]
    got = rows_of(spelling.variants(documents(spark, rows)))
    assert got == brute(brute_words(rows)) and got
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, "short few")])).count() == 0
