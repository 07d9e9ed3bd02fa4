"""Near-duplicate lines by a join of deletion neighbourhoods.

A line is its words. Two lines are near when one word added, left out or
replaced makes them equal, and both have MIN_WORDS words at least; shorter lines
are near only when equal. A line goes if an equal or near line stands earlier in
the input, by document id and line number.

Deleting one word from each of two near lines of equal length, or from the
longer one, gives the same words. So a line emits itself and all its words but
one, as hashed keys, and near lines share a key. Of the lines that share it only
the earliest matters, so keys meet in aggregates of minima and no pair is
listed. One edit leaves the first or the second half of a line as it was, so
lines whose halves occur nowhere else need not emit anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import END, cut, kept_by, line_stream, mix, plain_names, powers, prefix_hash, prepare, scratch, sorted_groups, span_hash, word_spans
from tiersmith.operators.joins import split_join

#: Of fewer words one word is so large a part that near lines are mostly chance.
MIN_WORDS = 4
#: Rows, of 50 bytes or less, that are broadcast rather than that texts are shuffled to them.
BROADCAST_ROWS = 1_000_000
#: Order of lines: document id, hash of the document, line number.
PLACE = ("doc_id", "row", "line")

_U = np.uint64


class Lines:
    """Lines with at least one word of a batch of texts, as spans of a word array."""

    def __init__(self, texts: pa.Array):
        kept_by("lines")
        data, per_row = line_stream(texts)
        ends = np.flatnonzero(data == END)
        starts, stops = word_spans(data)
        by_byte = prefix_hash(data)
        self.words = span_hash(by_byte, starts, stops)
        self.sums = prefix_hash(self.words)
        line = np.searchsorted(ends, starts)
        heads = sorted_groups(line)
        self.first, self.last = heads, np.concatenate((heads[1:], [len(line)])).astype(np.int64) if len(heads) else heads
        self.size = self.last - self.first
        number = line[heads]
        row_start = np.cumsum(per_row) - per_row
        self.row = np.searchsorted(row_start, number, side="right") - 1
        self.number = number - row_start[self.row]
        begin = np.concatenate(([0], ends[:-1] + 1))[number] if len(number) else number
        self.text_spans = (begin, ends[number])
        self.data = data
        self.by_words = span_hash(self.sums, self.first, self.last)
        self.by_bytes = span_hash(by_byte, *self.text_spans)

    def half_keys(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines and keys of their halves.

        Of L words the first L // 2 and the others are the halves. The longer
        line of a pair also has to match the halves of a line of one word less,
        which differ in the first half if L is even, else in the second.
        """
        first, last, size = self.first[lines], self.last[lines], self.size[lines]
        half, even = size // 2, size % 2 == 0
        heads = [(np.ones(len(lines), bool), half), (even, half - 1)]
        tails = [(np.ones(len(lines), bool), size - half), (~even, size - half - 1)]
        out = [(lines[m], mix(span_hash(self.sums, first[m], first[m] + n[m]))) for m, n in heads]
        out += [(lines[m], mix(span_hash(self.sums, last[m] - n[m], last[m]) + _U(1))) for m, n in tails]
        return np.concatenate([x for x, _ in out]), np.concatenate([k for _, k in out])

    def deletions(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Line, place of the deleted word (-1: none) and two hashes of what is left, of all variants."""
        count = self.size[lines] + 1
        line = np.repeat(lines, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) - 1
        a, b = self.first[line], self.last[line]
        out = []
        for sums in (self.sums, prefix_hash(mix(self.words + _U(1)))):
            whole = span_hash(sums, a, b)
            # the words after the deleted one move up by one
            _, down = powers(len(sums) + 1)
            j = np.maximum(a + at, a)
            short = (sums[j] - sums[a]) * down[a] + (sums[b] - sums[j + 1]) * down[a + 1]
            out.append(np.where(at < 0, whole, mix(short + (b - a - 1).astype(_U))))
        return line, at, out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _row(doc_id: str, text: str) -> tuple[Column, Column, Column]:
    """(doc_id, row, text): the id as a long, a hash of it and the text, and the text, empty if null."""
    number, string = F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return number.alias("doc_id"), F.xxhash64(number, string).alias("row"), string.alias("text")


def _identified(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, text). Rows equal in id and text are one document in two copies."""
    return df.select(*_row(doc_id, text))


def line_table(df: DataFrame) -> DataFrame:
    """(doc_id, row, line, h1, h2) of every line that has a word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = Lines(batch.column("text"))
            take = pa.array(x.row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(x.number, pa.int32()), _signed(x.by_words), _signed(x.by_bytes)], names=["doc_id", "row", "line", "h1", "h2"])

    return df.mapInArrow(run, "doc_id long, row long, line int, h1 long, h2 long")


def half_table(df: DataFrame, min_words: int) -> DataFrame:
    """(key, h1) of the halves of every line of ``min_words`` words or more, once for each batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = Lines(batch.column("text"))
            lines, keys = x.half_keys(np.flatnonzero(x.size >= min_words))
            both = np.unique(np.stack((keys, x.by_words[lines]), axis=1), axis=0) if len(keys) else np.zeros((0, 2), _U)
            yield pa.RecordBatch.from_arrays([_signed(np.ascontiguousarray(c)) for c in both.T], names=["key", "h1"])

    return df.mapInArrow(run, "key long, h1 long")


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a new table in the shared folder: computed once for all that read it, and packed tighter than a checkpoint."""
    path = f"{scratch(df.sparkSession)}/lines-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word added, left out or replaced at most makes the word lists equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = 0
    while same < len(a) and a[same] == b[same]:
        same += 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def removed_lines(df: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, line) of every line that goes.

    Lines without words stay. A null text has none. Ids order documents, null
    first; documents of one id are ordered by a hash, and rows equal in id and
    text count as one, so their lines stand or go together.
    """
    prepare(df.sparkSession)
    docs = _identified(df, doc_id, text)
    place = F.struct(*PLACE)
    lines = _written(line_table(docs))
    unique = _written(lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("n")))

    halves = _written(half_table(docs, min_words))
    shared = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    likely = halves.join(shared, "key", "left_semi").select("h1").distinct()
    chosen = unique.join(likely, "h1", "left_semi").select("place.*")
    by_doc = cut(chosen.groupBy("doc_id", "row").agg(F.collect_list("line").alias("lines")))
    n_docs, n_lines = by_doc.agg(F.count("*"), F.sum(F.size("lines"))).first()
    if max(n_docs, n_lines or 0) <= BROADCAST_ROWS:  # small enough to send to the documents; else these are shuffled
        by_doc = F.broadcast(by_doc)
    key = [docs["doc_id"].eqNullSafe(by_doc["doc_id"]), docs["row"] == by_doc["row"]]
    texts = docs.join(by_doc, key).select(docs["doc_id"], docs["row"], "lines", "text")

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = Lines(batch.column("text"))
            want = set()
            for r, lines_of in enumerate(batch.column("lines").to_pylist()):
                want.update((r, n) for n in lines_of)
            keep = np.array([(r, n) in want for r, n in zip(x.row.tolist(), x.number.tolist(), strict=True)], dtype=bool)
            chosen = np.flatnonzero(keep)
            raw = x.data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(x.text_spans[0][chosen], x.text_spans[1][chosen], strict=True)]
            take = pa.array(x.row[chosen])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(x.number[chosen], pa.int32()), _signed(x.by_words[chosen]), _signed(x.by_bytes[chosen]), pa.array(words, pa.string())], names=["doc_id", "row", "line", "h1", "h2", "words"])

    fetched = texts.mapInArrow(fetch, "doc_id long, row long, line int, h1 long, h2 long, words string")
    fetched = cut(fetched.dropDuplicates([*PLACE]))  # documents in two copies

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = Lines(batch.column("words"))
            line, at, v1, v2 = x.deletions(np.arange(len(x.size)))
            take = pa.array(x.row[line])
            yield pa.RecordBatch.from_arrays([_signed(v1), _signed(v2), pa.array(at, pa.int32()), *[batch.column(c).take(take) for c in PLACE]], names=["v1", "v2", "at", *PLACE])

    variants = fetched.mapInArrow(emit, "v1 long, v2 long, at int, doc_id long, row long, line int").withColumn("place", place).drop(*PLACE)
    # Most keys occur once. The others are few, and only their rows travel whole.
    twice = variants.groupBy("v1").agg(F.count("*").alias("n")).where("n > 1").select("v1")
    variants = cut(variants.join(twice, "v1", "left_semi"))
    # Of the lines that share a key, the earliest whole one (at = -1) and the earliest for each deleted place.
    firsts = variants.groupBy("v1", "v2", "at").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    by_key = variants.groupBy("v1", "v2").agg(F.min(F.when(F.col("at") < 0, F.col("place"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("place"))).alias("cut"))
    same_place = firsts.where("n > 1").select("v1", "v2", "at", "first")
    other = by_key.where("whole is not null and cut is not null")
    near = variants.join(same_place, ["v1", "v2", "at"]).select("place", F.col("first").alias("witness")).where("witness < place")
    added = variants.join(other, ["v1", "v2"]).select("place", F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")).alias("witness")).where("witness < place")
    pairs = near.unionAll(added).groupBy("place").agg(F.min("witness").alias("witness"))

    spots = fetched.select(place.alias("place"), "words", "h1", "h2")
    checked = pairs.join(spots, "place").join(spots.select(F.col("place").alias("witness"), F.col("words").alias("other")), "witness")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = (batch.column(c).to_pylist() for c in ("words", "other"))
            good = pa.array([within_one(p.split(" "), q.split(" ")) for p, q in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["h1", "h2"]).filter(good)

    near_removed = checked.select("h1", "h2", "words", "other").mapInArrow(verify, "h1 long, h2 long").withColumn("near", F.lit(True))
    gone = unique.join(near_removed, ["h1", "h2"], "left").where("near or n > 1").select("h1", "h2", F.col("place").alias("first"), "near")
    # A line may occur very often: next to the aggregate of ``unique`` this join could not be split at it.
    return split_join(lines, gone, ["h1", "h2"], "inner").where(F.col("near").isNotNull() | (F.col("first") < place)).select(*PLACE).distinct()


def drop_lines(df: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``df`` with its texts less the lines that go, joined by line breaks as before.

    No row goes: a text of which nothing is left is empty, a null text stays
    null. A column ``length``, if there is one, gets the characters that are left.
    """
    names = df.columns
    df, new = plain_names(df)
    doc_id, text, length = new[doc_id], new[text], new.get(length)
    gone = removed_lines(df, min_words, doc_id, text).groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_list("line").alias("_gone"))
    number, row, _ = _row(doc_id, text)
    marked = df.withColumn("_key", row)
    joined = marked.join(gone, number.eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_row")), "left")
    joined = joined.select(*df.columns, "_gone")
    inner = df.columns

    def rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(text).to_pylist()
            for i, gone in enumerate(batch.column("_gone").to_pylist()):
                if gone:
                    out = set(gone)
                    texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in out)
            columns = {c: batch.column(c) for c in inner}
            columns[text] = pa.array(texts, type=columns[text].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = joined.mapInArrow(rebuild, df.schema)
    if length:
        chars = F.length(F.col(text)).cast(df.schema[length].dataType)
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(chars))
    return out.toDF(*names)
