"""Removing byte strings that also start earlier in the corpus, by a run-length index.

Every window of ``length`` bytes has a centre: the least hash among the short
strings inside it. Consecutive windows of one centre on the same side of it are a
run, and what all windows of that side have in common, the centre and half of
what is around it, is the run's anchor. Equal windows have equal centres at equal
distances and so equal anchors, and runs can be compared anchor by anchor,
wherever they are. A common line that is shorter than an anchor joins no runs.

1. A block finds its runs, and keeps of equal runs the first. It asks buckets
   which of its runs also occur before, and which anchors occur in other runs.
2. A run that occurs before is removed. One whose anchor has other runs is sent
   on, as bytes, to where the runs of its anchor meet; an anchor with very many
   runs is taken apart into windows, which meet by their own hash.
3. Where they meet a run-compressed index is built of those that have company
   there, and its matching statistics show which windows are also in an earlier run.
4. The blocks get back what is covered, a row for each span, and cut it out.

What is sent from a block is a few bytes for each anchor, and the bytes of runs
that differ around a common anchor. Copies meet inside a block first, so a
passage that fills the corpus arrives once from each block. A bucket takes the
keys of a range, and there are few buckets, so that a message has many keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame

from tiersmith.llm.common import blocked, mix, powers, prefix_hash, prepare, sorted_groups, span_hash, string_buffer
from tiersmith.llm.exchange import opened, opened_keys, shut, shut_keys
from tiersmith.llm.run_index import RunIndex

LENGTH = 100
ANCHOR = 32
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 17  # arrays over a chunk stay in the processor's cache
MANY_RUNS = 4_096
MEETS_PER_BLOCK = 8  # an index needs some hundred bytes of memory for each byte that it holds
FEW_BUCKETS = 64
SAME, ANCHORS = 0, 1  # kinds of questions
GONE, SHARED, CROWDED = 1, 2, 3  # answers
COVER, RUNS = 0, 1  # kinds of rows that go on
_U = np.uint64
_LOW, _REST = _U((1 << 48) - 1), _U(16)  # lower bits kept, and bits left out to keep the upper ones


@dataclass
class Runs:
    """Runs of a block in order of document and place: bytes [start, end) of document ``doc``, windows up to ``last``."""

    doc: np.ndarray
    start: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    content: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


class Block:
    """Documents of a block in order of id, then text."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
        data, offsets = string_buffer(table["text"])
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids = ids[order]
        self.null = [table["doc_id"][i].as_py() is None for i in order]
        self.texts = [texts[i] for i in order]

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        start = 0
        while start < len(self.texts):
            stop, size = start, 0
            while stop < len(self.texts) and (stop == start or size + len(self.texts[stop]) <= CHUNK_BYTES):
                size += len(self.texts[stop])
                stop += 1
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.texts[start:stop]])))
            yield start, np.frombuffer(b"".join(self.texts[start:stop]), dtype=np.uint8), offsets
            start = stop

    def runs(self, length: int, anchor: int) -> Runs:
        parts = [_runs(first, data, offsets, length, anchor) for first, data, offsets in self.chunks()]
        if not parts:
            return Runs(*[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U)])
        return Runs(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def _runs(first: int, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    sums = prefix_hash(data)
    _, down = powers(n + 1)
    hashes = mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    # Least of the hashes inside each window, the leftmost of equals: upper half hash, lower half place.
    least = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=_U)
    width, reach = length - anchor + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    counts = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each document
    at = np.arange(counts.sum()) + np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts)
    place = (least[at] & _U(0xFFFFFFFF)).astype(np.int64)
    half = (length - anchor + 1) // 2
    before = place - at >= half  # whether at least this much of the window stands before its centre
    heads = sorted_groups(2 * place + before)
    a, b = at[heads], at[np.concatenate((heads[1:], [len(at)])).astype(np.int64) - 1] if len(heads) else at[heads]
    place, before = place[heads], before[heads]
    content = mix(span_hash(sums, a, b + length) + mix((place - a).astype(_U)))
    wide = span_hash(sums, np.where(before, place - half, place), np.where(before, place + anchor, place + length - half + 1))
    doc = np.searchsorted(offsets, a, side="right") - 1
    return doc + first, a - offsets[doc], b - offsets[doc], wide, content


def _order(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of the keys, equal ones as they stand: as np.lexsort of the keys reversed.

    The first key, spread over all 64 bits, is sorted with the place instead of its last bits. Only places
    that are not told apart by that are sorted by all keys.
    """
    n = len(keys[0])
    mask = _U((1 << n.bit_length()) - 1)
    both = keys[0] - keys[0].min(initial=_U((1 << 64) - 1))
    both <<= _U(min(63, 64 - int(both.max(initial=0)).bit_length()))
    both = np.sort((both & ~mask) | np.arange(n, dtype=_U))
    order = (both & mask).astype(np.int64)
    tied = _alike(both & ~mask)
    some = order[tied]
    order[tied] = some[np.lexsort(tuple(k[some] for k in reversed(keys)))]
    return order


def _alike(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys are equal to one beside them."""
    equal = np.zeros(len(keys) + 1, dtype=bool)
    equal[1:-1] = keys[1:] == keys[:-1]
    return equal[1:] | equal[:-1]


def _first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each group of equal keys, sorted by the keys, and the group of every place."""
    order = _order(*keys)  # the first place of a group comes first
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


QUESTION = "kind int, bucket int, block int, key binary, extra binary, number binary"
ANSWER = "kind int, bucket int, block int, answer binary"


def _n_buckets(blocks: int) -> int:
    """Two for each block, but of many blocks one for two, since the messages are as many as blocks times buckets."""
    return min(2 * blocks, max(FEW_BUCKETS, blocks // 2))


def _edges(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends in sorted keys of so many bits: a bucket has an equal part of their range."""
    return np.searchsorted(((keys >> _U(bits - 32)) * _U(buckets)) >> _U(32), np.arange(buckets + 1).astype(_U))


def _questions(runs: Runs, ids: np.ndarray, buckets: int, ask: bool = True) -> tuple[dict, list[tuple]]:
    """What a block asks: for each distinct run its least document, for each distinct anchor its run and their number.

    Without ``ask`` only what is needed to read the answers, which come in the order of buckets and keys.
    """
    first, group = _first_of_equal(runs.anchor, runs.content)
    # one key of 96 bits for a run: 64 sorted and 32 beside it
    one = mix(runs.anchor[first] ^ mix(runs.content[first]))
    two = (runs.content[first] & _U(0xFFFFFFFF)).astype(np.uint32)
    same = _order(one)
    heads = sorted_groups(runs.anchor[first])
    anchors = runs.anchor[first][heads] >> _REST
    content = runs.content[first][heads] & _LOW
    number = np.diff(np.concatenate((heads, [len(first)]))).astype(np.int64)
    asked = {SAME: (64, one[same], two[same], ids[runs.doc[first]][same]), ANCHORS: (48, anchors, content, number)}
    out = []
    for kind, (bits, key, extra, number_of) in asked.items() if ask else ():
        edges = _edges(key, bits, buckets)
        for bucket, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            if x < y:  # so that there are never more messages than keys
                out.append((kind, bucket, shut_keys(key[x:y]), shut(extra[x:y]), shut(number_of[x:y])))
    return {"first": first, "group": group, "same": same, "anchor_of": np.repeat(np.arange(len(heads)), number)}, out


def _asking(length: int, anchor: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table)
        _, rows = _questions(block.runs(length, anchor), block.ids, buckets)
        kind, bucket, keys, extra, number = zip(*rows, strict=True) if rows else ((),) * 5
        n = len(rows)
        return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "block": pa.array([key[0].as_py()] * n, pa.int32()), "key": pa.array(keys, pa.binary()), "extra": pa.array(extra, pa.binary()), "number": pa.array(number, pa.binary())})

    return run


def _with_others(keys: np.ndarray) -> np.ndarray:
    """Places of the keys that occur more than once, by key."""
    order = _order(keys)
    return order[_alike(keys[order])]


def _answering(many: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind, bucket = (k.as_py() for k in key)
        keys = [opened_keys(x) for x in rows["key"].to_pylist()]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        extra = np.concatenate([opened(x, np.uint32 if kind == SAME else np.uint64) for x in rows["extra"].to_pylist()])
        number = np.concatenate([opened(x, np.int64) for x in rows["number"].to_pylist()])
        answer = np.zeros(len(keys), dtype=np.uint8)
        if kind == SAME:
            order = _with_others(keys)
            order = order[np.lexsort((number[order], extra[order], keys[order]))]
            later = np.zeros(len(order), dtype=bool)
            later[1:] = (keys[order][1:] == keys[order][:-1]) & (extra[order][1:] == extra[order][:-1])
            answer[order[later]] = GONE
        elif len(keys):
            answer[number > 1] = np.where(number[number > 1] > many, CROWDED, SHARED)  # those that no other block asks about
            order = _with_others(keys)
            heads = sorted_groups(keys[order])
            if len(heads):
                total = np.add.reduceat(number[order], heads)
                differ = (np.minimum.reduceat(extra[order], heads) != np.maximum.reduceat(extra[order], heads)) | (np.maximum.reduceat(number[order], heads) > 1)
                answer[order] = np.repeat(np.where(differ, np.where(total > many, CROWDED, SHARED), 0), np.diff(np.concatenate((heads, [len(order)]))))
        ends = np.cumsum(sizes)
        n = len(sizes)
        return pa.table({"kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "block": rows["block"].combine_chunks(), "answer": pa.array([shut(answer[e - s : e]) for s, e in zip(sizes, ends, strict=True)], pa.binary())})

    return run


ONWARD = "meet long, kind int, block int, key long, doc_id long, doc int, start long, bytes binary"


def _sending_on(length: int, anchor: int, buckets: int, meets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """What is covered already, and the runs that have to meet others."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block_no, block = key[0].as_py(), Block(table)
        runs = block.runs(length, anchor)
        known, _ = _questions(runs, block.ids, buckets, ask=False)
        got = {}
        for kind in (SAME, ANCHORS):
            mine = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("bucket")
            got[kind] = np.concatenate([np.zeros(0, np.uint8), *(opened(x, np.uint8) for x in mine["answer"].to_pylist())])
        first, group = known["first"], known["group"]
        gone = np.zeros(len(first), dtype=bool)
        gone[known["same"]] = got[SAME] == GONE
        state = got[ANCHORS][known["anchor_of"]]
        is_first = np.zeros(len(runs), dtype=bool)
        is_first[first] = True
        covered = ~is_first | gone[group] if len(runs) else is_first
        cover = [(runs.doc[covered], runs.start[covered], runs.last[covered] + length)]
        rest = np.zeros(len(runs), np.uint8)
        rest[first] = np.where(gone, 0, state)
        shared, crowded = np.flatnonzero(rest == SHARED), np.flatnonzero(rest == CROWDED)
        meet, doc, start, data = [runs.anchor[shared]], [runs.doc[shared]], [runs.start[shared]], []
        data += [block.texts[d][a : b + length] for d, a, b in zip(runs.doc[shared], runs.start[shared], runs.last[shared], strict=True)]
        if len(crowded):  # windows, each by its own hash; the first of equal ones inside the block goes on
            size = runs.last[crowded] - runs.start[crowded] + 1
            d = np.repeat(runs.doc[crowded], size)
            s = np.repeat(runs.start[crowded] - np.cumsum(size) + size, size) + np.arange(size.sum())
            windows = [block.texts[x][y : y + length] for x, y in zip(d.tolist(), s.tolist(), strict=True)]
            seen: dict[bytes, int] = {}
            keep = np.array([seen.setdefault(w, i) == i for i, w in enumerate(windows)])
            cover.append((d[~keep], s[~keep], s[~keep] + length))
            kept = np.flatnonzero(keep)
            chosen = [windows[i] for i in kept]
            meet.append(np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in chosen], dtype=_U))
            doc.append(d[kept])
            start.append(s[kept])
            data += chosen
        meet, doc, start = (np.concatenate(x) for x in (meet, doc, start))
        n = len(doc)
        return pa.table(
            {
                "meet": pa.array(np.concatenate(((mix(meet) % _U(meets)).astype(np.int64), [meets + block_no]))),
                "kind": pa.array([RUNS] * n + [COVER], pa.int32()),
                "block": pa.array([block_no] * (n + 1), pa.int32()),
                "key": pa.array(np.concatenate((meet, np.zeros(1, _U))).view(np.int64)),
                "doc_id": pa.array(np.concatenate((block.ids[doc], [0])) if n else np.zeros(1, np.int64)),
                "doc": pa.array(np.concatenate((doc, [0])), pa.int32()),
                "start": pa.array(np.concatenate((start, [0])), pa.int64()),
                "bytes": pa.array([*data, shut(np.concatenate(_joined(*(np.concatenate(x) for x in zip(*cover, strict=True)))))], pa.binary()),
            }
        )

    return run


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents in their order, overlapping and touching ones joined."""
    doc, start, end = (x.astype(np.int64) for x in (doc, start, end))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc):
        # A running maximum of ends inside each document: documents are set apart by more than any text is long.
        apart = doc * (int(end.max()) + 2)
        reach = np.maximum.accumulate(end + apart)
        new = np.concatenate(([True], (start + apart)[1:] > reach[:-1]))
        heads = np.flatnonzero(new)
        lasts = np.concatenate((heads[1:], [len(doc)])) - 1
        doc, start, end = doc[heads], start[heads], reach[lasts] - apart[heads]
    return doc, start, end


COVERED = "block int, doc int, start long, end long, cover binary"


def _meeting(length: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Windows that are also in an earlier run, by a run-length index of the runs that meet here."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if rows["kind"][0].as_py() == COVER:
            nothing = pa.nulls(rows.num_rows)
            return pa.table({"block": rows["block"], "doc": nothing.cast(pa.int32()), "start": nothing.cast(pa.int64()), "end": nothing.cast(pa.int64()), "cover": rows["bytes"]})
        # A run that is alone with its anchor repeats nothing, and neither does a window alone with its hash.
        rows = rows.take(pa.array(_with_others(rows["key"].to_numpy().view(_U))))
        rows = rows.sort_by([("doc_id", "ascending"), ("doc", "ascending"), ("start", "ascending")])
        block, doc, start = (rows[c].to_numpy() for c in ("block", "doc", "start"))
        if not len(rows):
            return pa.table({"block": pa.array([], pa.int32()), "doc": pa.array([], pa.int32()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64()), "cover": pa.array([], pa.binary())})
        index = RunIndex(rows["bytes"].to_pylist())
        repeated = index.repeated(length)  # no end of a text is, so what is repeated without a gap is of one text
        a, b = np.flatnonzero(np.diff(repeated, prepend=False, append=False)).reshape(-1, 2).T
        text = np.searchsorted(index.ends, a, side="right")
        start = start[text] + a - index.starts[text]
        return pa.table({"block": pa.array(block[text], pa.int32()), "doc": pa.array(doc[text], pa.int32()), "start": pa.array(start, pa.int64()), "end": pa.array(start + b - a + length - 1, pa.int64()), "cover": pa.nulls(len(text), pa.binary())})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cutting(keep_text: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, covers: pa.Table) -> pa.Table:
        block = Block(table)
        spans = [opened(x, np.int64).reshape(3, -1) for x in covers["cover"].drop_null().to_pylist()]
        rows = covers.filter(pa.compute.is_null(covers["cover"]))
        spans.append(np.stack([rows[c].to_numpy().astype(np.int64) for c in ("doc", "start", "end")]))
        doc, start, end = _joined(*np.concatenate(spans, axis=1))
        edges = np.searchsorted(doc, np.arange(len(block.texts) + 1)).tolist()
        kept, removed, n_spans = [], [], []
        for i, text in enumerate(block.texts):
            a, b = edges[i], edges[i + 1]
            n_spans.append(b - a)
            removed.append(int((end[a:b] - start[a:b]).sum()))
            if a < b:
                marks = [0, *np.stack((start[a:b], end[a:b]), axis=1).ravel().tolist(), len(text)]
                text = b"".join(text[x:y] for x, y in zip(marks[::2], marks[1::2], strict=True))
            kept.append(text)
        out = {
            "doc_id": pa.array([None if null else i for i, null in zip(block.ids.tolist(), block.null, strict=True)], pa.int64()),
            "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept]),
        }
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return run


def remove_repeats(df: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, many: int = MANY_RUNS, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with ``keep_text`` also the bytes ``kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document of smaller id, or before in the same document.
    Strings are judged on the input and never cross documents. A null text is
    empty. A null id comes before all others; rows of one id are ordered by
    their texts, and of rows equal in both the first in any order stays.
    ``anchor`` is the length of the strings that the blocks compare first.
    """
    prepare(df.sparkSession)
    rows, blocks = blocked(df, doc_id, text, block_bytes)
    buckets = _n_buckets(blocks)
    asked = rows.groupBy("block").applyInArrow(_asking(length, anchor, buckets), QUESTION)
    answers = asked.groupBy("kind", "bucket").applyInArrow(_answering(many), ANSWER)
    meets = MEETS_PER_BLOCK * blocks
    onward = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sending_on(length, anchor, buckets, meets), ONWARD)
    covered = onward.groupBy("meet").applyInArrow(_meeting(length), COVERED)
    schema = RESULT + (", kept binary" if keep_text else "")
    return rows.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(_cutting(keep_text), schema)
