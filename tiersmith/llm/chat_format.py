"""Chat formatting of turns whose content is a list of typed parts.

A visitor has a method for each type of part and says what stands for it in the
text: a text part its escaped text, an image, audio or document part a placeholder.
The placeholders stand in the order of the parts; the reference of each, the place
of its placeholder and the number of tokens that it expands to are recorded.

Control strings open with one of two brackets and hold no other. Inside texts a
backslash goes behind the bracket of anything that reads like one, after any that
are there already, so that texts hold no control string and ``unescape`` gives them
back. A conversation is a list of turn segments; it is stored in parts of bounded
length, so that one that holds much of a table is many rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import prepare
from tiersmith.operators.ordering import BUCKET_ROWS, hot_groups, running_total

CONTENT = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Characters of one stored part; one more turn may begin in it and is not cut.
PART_CHARS = 1 << 16


@dataclass(frozen=True)
class Template:
    """Control strings. Turns of ``default`` have no opening string and end with ``stop``; ``roles`` have a pair of their
    own; any other role is named between the strings of ``named``, and its turn ends with ``stop`` too."""

    begin: str = "<s>"
    stop: str = "</s>"
    default: str = "assistant"
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]")})
    named: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    next_text: str = "[TEXT]"
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"})
    other: str = "[PART]"

    def control(self) -> list[str]:
        """All control strings."""
        pairs = [s for pair in self.roles.values() for s in pair]
        return [self.begin, self.stop, *pairs, *self.named, self.next_text, *self.placeholders.values(), self.other]

    def pattern(self, escapes: str) -> str:
        """Control strings with the backslashes matched by ``escapes`` behind their bracket: bracket, backslashes, rest.
        The same expression in Python, Java and SQL."""
        for text in self.control():
            if not re.fullmatch(r"[<\[][^<\[\\]+", text):
                raise ValueError(f"{text!r} does not open with its only bracket")
        rests = sorted({re.escape(text[1:]) for text in self.control()})
        return rf"([<\[]){escapes}({'|'.join(rests)})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern(r"\\(\\*)"), r"\1\2\3", text)


@dataclass(frozen=True)
class PartVisitor:
    """What stands for a part: struct(piece, learn, kind, ref, n_tokens). ``learn`` is the length of text in the piece;
    ``kind`` is null for text. A missing or negative size counts as 0."""

    template: Template
    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 1024

    def visit(self, part: Column, index: Column) -> Column:
        found = F.when(part["type"] == "text", self.text(part, index))
        for kind, method in (("image", self.image), ("audio", self.audio), ("document", self.document)):
            found = found.when(part["type"] == kind, method(part))
        return found.otherwise(self.unknown(part))

    def text(self, part: Column, index: Column) -> Column:
        escaped = self.template.escape(F.coalesce(part["text"], F.lit("")))
        # Texts side by side have a string between them: together they might read like a control string.
        piece = F.concat(F.when(index > 0, self.template.next_text).otherwise(""), escaped)
        return self._struct(piece, F.length(escaped), F.lit(None), F.lit(None), F.lit(0))

    def image(self, part: Column) -> Column:
        return self._attached(part, "image", F.ceil(_size(part["width"]) / self.patch) * F.ceil(_size(part["height"]) / self.patch))

    def audio(self, part: Column) -> Column:
        return self._attached(part, "audio", F.ceil(_size(part["seconds"]) * self.audio_rate))

    def document(self, part: Column) -> Column:
        return self._attached(part, "document", _size(part["pages"]) * self.page_tokens)

    def unknown(self, part: Column) -> Column:
        return self._struct(F.lit(self.template.other), F.lit(0), F.coalesce(part["type"], F.lit("")), part["ref"], F.lit(0))

    def _attached(self, part: Column, kind: str, tokens: Column) -> Column:
        return self._struct(F.lit(self.template.placeholders[kind]), F.lit(0), F.lit(kind), part["ref"], tokens)

    @staticmethod
    def _struct(piece: Column, learn: Column, kind: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(
            piece.alias("piece"),
            learn.cast("long").alias("learn"),
            kind.cast("string").alias("kind"),
            ref.cast("string").alias("ref"),
            tokens.cast("long").alias("n_tokens"),
        )


def _size(value: Column) -> Column:
    return F.greatest(F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def text_content(text: Column) -> Column:
    """Plain text as the content of a turn: one text part. A null text is an empty part."""
    none = [F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *none)).cast(CONTENT)


def turn_segments(turns: DataFrame, template: Template, visitor: PartVisitor, learn: Sequence[str]) -> DataFrame:
    """(conv_id, turn, role, raw, segment, marks): the text of each turn, and the place (from its start) of what is
    learned or attached."""
    role = F.col("role")
    opening, closing = F.when(role == template.default, F.lit("")), F.when(role == template.default, F.lit(template.stop))
    for name, (a, b) in template.roles.items():
        opening, closing = opening.when(role == name, F.lit(a)), closing.when(role == name, F.lit(b))
    opening = opening.otherwise(F.concat(F.lit(template.named[0]), template.escape(role), F.lit(template.named[1])))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(role, F.lit("")).alias("role"),
        F.filter(F.coalesce(F.col("content").cast(CONTENT), F.array().cast(CONTENT)), lambda p: p.isNotNull()).alias("content"),
    )
    rows = rows.withColumns({"opening": opening, "closing": closing.otherwise(F.lit(template.stop)), "learned": role.isin(*learn)})
    rows = rows.withColumn("pieces", F.transform("content", visitor.visit))
    # Where each piece ends: a running sum, carried with the marks of the pieces so far.
    start = F.struct(F.length("opening").cast("long").alias("at"), F.array().cast("array<struct<at:long,learn:long,kind:string,ref:string,n_tokens:long>>").alias("marks"))

    def add(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece["piece"])
        counts = F.when(piece["kind"].isNull(), F.col("learned") & (piece["learn"] > 0)).otherwise(True)
        taken = F.when(piece["kind"].isNull(), piece["learn"]).otherwise(0)
        back = F.when(piece["kind"].isNull(), piece["learn"]).otherwise(F.length(piece["piece"]))
        mark = F.struct((end - back).alias("at"), taken.cast("long").alias("learn"), piece["kind"].alias("kind"), piece["ref"].alias("ref"), piece["n_tokens"].alias("n_tokens"))
        return F.struct(end.cast("long").alias("at"), F.when(counts, F.concat(state["marks"], F.array(mark))).otherwise(state["marks"]).alias("marks"))

    marks = F.aggregate("pieces", start, add)["marks"]
    segment = F.concat("opening", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), "closing")
    return rows.select("conv_id", "turn", "role", segment.alias("segment"), marks.alias("marks"))


def format_chat(
    turns: DataFrame,
    template: Template = Template(),  # noqa: B008  frozen
    visitor: PartVisitor | None = None,
    learn: Sequence[str] = ("assistant",),
    part_chars: int = PART_CHARS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Format the turns (conv_id, turn, role, content) of every conversation.

    Returns (conv_id, part, start, formatted, n_turns, loss, attachments, n_tokens):
    the conversation is the ``formatted`` texts of its parts, one after the other, and
    ``start`` is where a part begins in it. ``loss`` has the spans [start, end) of what
    is learned: the text parts of the ``learn`` roles, without control strings.
    ``attachments`` has (at, kind, ref, n_tokens) in the order of the placeholders, ``at`` being
    the place of the placeholder, and ``n_tokens`` their sum. Places count code points of
    the whole conversation.

    Turns are ordered by turn (null first), then role, then segment; repeated rows are
    repeated turns. A null conv_id is a conversation of its own, a null role the role
    of empty name, a null content no parts, a null part is none, a null text is empty. Parts of
    another type become a placeholder of their own with 0 tokens. A part of a
    conversation holds whole turns and begins anew after ``part_chars`` characters, so a
    turn of any length stays whole. Empty tables give no rows; further columns are not read, whatever their names.
    """
    prepare(turns.sparkSession)
    visitor = visitor or PartVisitor(template)
    segments = turn_segments(turns, template, visitor, learn)
    hot = hot_groups(turns.select("conv_id"), ["conv_id"], bucket_rows)
    placed = running_total(segments, ["conv_id"], ["turn", "role", "segment"], F.length("segment"), "end", hot)
    begin = len(template.begin)
    placed = placed.withColumn("start", F.col("end") - F.length("segment") + begin)
    placed = placed.withColumn("part", F.floor((F.col("start") - begin) / part_chars).cast("long"))
    moved = F.transform("marks", lambda m: F.struct((m["at"] + F.col("start")).alias("at"), m["learn"], m["kind"], m["ref"], m["n_tokens"]))
    items = F.array_sort(F.collect_list(F.struct("start", "segment", moved.alias("marks"))))
    parts = placed.groupBy("conv_id", "part").agg(items.alias("items"))
    first = F.col("part") == 0
    marks = F.flatten(F.transform("items", lambda i: i["marks"]))
    attached = F.filter(marks, lambda m: m["kind"].isNotNull())
    return parts.select(
        "conv_id",
        "part",
        F.when(first, 0).otherwise(F.col("items")[0]["start"]).cast("long").alias("start"),
        F.concat(F.when(first, template.begin).otherwise(""), F.array_join(F.transform("items", lambda i: i["segment"]), "")).alias("formatted"),
        F.size("items").alias("n_turns"),
        F.transform(F.filter(marks, lambda m: m["kind"].isNull()), lambda m: F.struct(m["at"].alias("start"), (m["at"] + m["learn"]).alias("end"))).alias("loss"),
        F.transform(attached, lambda m: F.struct(m["at"], m["kind"], m["ref"], m["n_tokens"])).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, m: s + m["n_tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: str, template: Template) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Turns of a part of a conversation: (role, parts), a part being (type, text); the text of a placeholder is the
    control string itself. Texts are as they were before escaping."""
    marks = {template.next_text: "text", template.other: "other"} | {s: kind for kind, s in template.placeholders.items()}
    inner = re.compile("|".join(re.escape(s) for s in sorted(marks, key=len, reverse=True)))
    at = len(template.begin) if formatted.startswith(template.begin) else 0
    while at < len(formatted):
        role, closing = template.default, template.stop
        for name, (a, b) in template.roles.items():
            if formatted.startswith(a, at):
                role, closing, at = name, b, at + len(a)
                break
        else:
            if formatted.startswith(template.named[0], at):
                at += len(template.named[0])
                end = formatted.index(template.named[1], at)
                role, at = template.unescape(formatted[at:end]), end + len(template.named[1])
        end = formatted.index(closing, at)
        parts, kind, since = [], "text", at
        for found in inner.finditer(formatted, at, end):
            if kind == "text" and (found.start() > since or since > at):
                parts.append(("text", template.unescape(formatted[since : found.start()])))
            kind, since = marks[found.group()], found.end()
            if kind != "text":
                parts.append((kind, found.group()))
        if kind == "text" and (end > since or since > at):
            parts.append(("text", template.unescape(formatted[since:end])))
        yield role, parts
        at = end + len(closing)


def checked_chat(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008  frozen
    """What the parts of ``format_chat`` hold, read from them: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_attachments, n_tokens) of every conversation.

    A digest runs over a conversation from its first turn to its last, so its rows are one task's, which reads them in
    order, a batch at a time, and keeps the digest only.
    """
    prepare(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens long"

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        counts, turns, loss = [0] * 5, hashlib.sha256(), hashlib.sha256()
        ids, rows = [], []

        def close() -> None:
            ids.append(now[0])
            rows.append((counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), *counts[2:]))

        def batch() -> pa.RecordBatch:
            found = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(ids, type=id_type), *[pa.array(c, type=t) for c, t in zip(found, types, strict=True)]]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens"])

        id_type = None
        for got in it:
            id_type = got.schema.field("conv_id").type
            for row in got.to_pylist():
                if now != (row["conv_id"],):
                    if now:
                        close()
                    now, counts, turns, loss = (row["conv_id"],), [0] * 5, hashlib.sha256(), hashlib.sha256()
                text = row["formatted"]
                for role, parts in read_turns(text, template):
                    said = "".join(t for _, t in parts)
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for span in row["loss"]:
                    learned = template.unescape(text[span["start"] - row["start"] : span["end"] - row["start"]])
                    loss.update(learned.encode())
                    counts[1] += len(learned)
                counts[2] += len(text)
                counts[3] += len(row["attachments"])
                counts[4] += row["n_tokens"]
            if rows:
                yield batch()
                ids, rows = [], []
        if now:
            close()
            yield batch()

    placed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return placed.select("conv_id", "start", "formatted", "loss", "attachments", "n_tokens").mapInArrow(digest, schema)
