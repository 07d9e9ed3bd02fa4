"""Chat formatting: round trips, typed parts, masks, escapes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tiersmith.llm.chat_format import CONTENT, PartVisitor, Template, checked_chat, format_chat, read_turns, text_content

SCHEMA = f"conv_id long, turn long, role string, content {CONTENT}"
NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST]x[INST", "<s><\\s></s>", "\\", "[[/INST]", "[IMG][TEXT]", "a[", "", "é😀[ROLE]\n\n", "[INST>", "$1\\2"]


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def conversations(parts, template=Template()):  # noqa: B008
    """Turns by conversation, read from the stored parts in order."""
    out = {}
    for r in sorted(parts, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part)):
        out.setdefault(r.conv_id, []).extend(read_turns(r.formatted, template))
    return out


def test_any_text_and_role_survives(spark):
    roles = ["user", "assistant", "system", "tool", "[/ROLE]", "", "assistant "]
    turns = [(c, k, role, [part("text", text)]) for c, role in enumerate(roles) for k, text in enumerate(NASTY)]
    got = format_chat(spark.createDataFrame(turns, SCHEMA)).collect()
    for c, read in conversations(got).items():
        assert read == [(roles[c], [("text", t)] if t else []) for t in NASTY]
    for r in got:
        assert r.formatted.startswith("<s>") and r.n_turns == len(NASTY)


@pytest.mark.parametrize("part_chars", [1, 40, 1 << 16])
def test_masks_cover_assistant_texts_once(spark, part_chars):
    turns = [(c, k, ["user", "assistant"][k % 2], [part("text", t), part("image", ref="i", width=28, height=15), part("text", NASTY[-k])]) for c in (1, 2) for k, t in enumerate(NASTY)]
    df = format_chat(spark.createDataFrame(turns, SCHEMA), part_chars=part_chars)
    rows = sorted(df.collect(), key=lambda r: (r.conv_id, r.part))
    for c in (1, 2):
        own = [r for r in rows if r.conv_id == c]
        whole = "".join(r.formatted for r in own)
        assert all(whole[r.start : r.start + len(r.formatted)] == r.formatted for r in own)
        said = [Template().unescape(whole[s.start : s.end]) for r in own for s in r.loss]
        assert said == [t for k, x in enumerate(NASTY) if k % 2 for t in (x, NASTY[-k]) if t]
        assert all(whole[a.at :].startswith("[IMG]") and a.n_tokens == 4 for r in own for a in r.attachments)
        assert sum(len(r.attachments) for r in own) == len(NASTY) and whole.count("[IMG]") == len(NASTY)
    assert (len(rows) > 2) == (part_chars < 100)


def test_typed_parts(spark):
    content = [
        part("image", ref="a.png", width=15, height=14),
        part("text", "see [IMG]"),
        part("text", "[IN"),
        part("text", "ST]"),
        part("audio", ref="b.wav", seconds=1.01),
        part("document", ref="c.pdf", pages=3),
        part("video", ref="d"),
        part(None, "lost", ref="e"),
        None,
        part("image", width=-5, height=3),
        part("audio", seconds=float("nan")),
    ]
    (row,) = format_chat(spark.createDataFrame([(1, 0, "user", content)], SCHEMA)).collect()
    kinds = ["image", "audio", "document", "video", "", "image", "audio"]
    assert [a.kind for a in row.attachments] == kinds and [a.ref for a in row.attachments] == ["a.png", "b.wav", "c.pdf", "d", "e", None, None]
    assert [a.n_tokens for a in row.attachments] == [2, 26, 3072, 0, 0, 0, 0] and row.n_tokens == 3100
    ((role, parts),) = read_turns(row.formatted, Template())
    assert role == "user" and [k for k, _ in parts] == ["image", "text", "text", "text", "audio", "document", "other", "other", "image", "audio"]
    assert [t for k, t in parts if k == "text"] == ["see [IMG]", "[IN", "ST]"] and row.loss == []
    costs = PartVisitor(Template(), patch=7, audio_rate=10, page_tokens=2)
    (row,) = format_chat(spark.createDataFrame([(1, 0, "user", content)], SCHEMA), visitor=costs).collect()
    assert [a.n_tokens for a in row.attachments[:3]] == [6, 11, 6]


def test_nulls_ties_and_clashing_names(spark):
    turns = [(None, 1, None, [part("text", "x")]), (None, None, "user", None), (5, 1, "assistant", [part("text")]), (5, 1, "assistant", [part("text")]), (5, 0, "user", [])]
    df = spark.createDataFrame(turns, SCHEMA)
    for name in ("segment", "marks", "start", "end", "part", "opening", "pieces", "learned", "formatted"):
        df = df.withColumn(name, F.lit(1))
    got = conversations(format_chat(df).collect())
    assert got == {None: [("user", []), ("", [("text", "x")])], 5: [("user", []), ("assistant", []), ("assistant", [])]}
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
    assert checked_chat(format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


def test_digests_are_those_of_the_input(spark):
    long = "[INST]" * 60_000
    turns = [(c, k, ["user", "assistant"][k % 2], t) for c in (3, None) for k, t in enumerate([*NASTY, None, long, long])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("content", text_content(F.col("text")))
    for bucket_rows in (2, 1_000):  # a conversation in ranges, and in one window
        for r in checked_chat(format_chat(df, part_chars=100, bucket_rows=bucket_rows)).collect():
            own = [t for t in turns if t[0] == r.conv_id]
            learned = "".join(t[3] or "" for t in own if t[2] == "assistant")
            assert r.n_turns == len(own) and r.loss_chars == len(learned)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
            assert r.formatted_chars > sum(len(t[3] or "") for t in own)


def test_control_strings_must_be_told_apart():
    with pytest.raises(ValueError, match="only bracket"):
        Template(begin="begin").pattern(r"(\\*)")
