"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes long, with counts of what
follows. A byte is predicted in the longest context that has been seen; if it
has not followed there, the model escapes to the next shorter one, in which what
could have followed before is excluded. In a context that was followed T times
by D kinds of bytes, a byte that came n times has (2n - 1) / 2T and the escape D / 2T
(method D), with the excluded bytes taken out of T and D. Below order 0 all
bytes that never occurred are equally likely.

A text is its tokens: A-Z in lower case, words with one blank between them, and
an end mark, which is also what stands before a text. Contexts of two bytes and
more are counted by the blocks and buckets of ``exchange``; shorter ones fit in
a table of 256 x 256 numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import END, blocked, mix, prefix_hash, prepare, remainder, sorted_groups, span_hash, token_stream, word_spans
from tiersmith.llm.exchange import MESSAGE, ask, by_bucket, message_table, messages, opened

ORDER = 5
DISCOUNT = 0.4
BLOCK_BYTES = 16 << 20
CHUNK_ROWS = 1 << 21
MOST_BUCKETS = 4_096  # each block writes to each of them; there are not many more pairs of bytes in use
GRAMS, WORDS = 0, 1
_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte of a stream the byte and the ``order`` before it, as one number; END stands before a row."""
    if not len(data):
        return np.zeros(0, _U)
    padded = bytes([END]) * 7 + data.tobytes()
    size = 8 * (order + 1)
    pad = int.from_bytes(bytes([END]) * (order + 1), "big")
    out = np.ndarray(shape=(len(data),), dtype=">u8", buffer=padded, strides=(1,)).astype(_U)
    out &= _U((1 << size) - 1)
    starts, ends = offsets[:-1], offsets[1:]
    for seen in range(order):
        at = starts[starts + seen < ends] + seen
        low = (1 << 8 * (seen + 1)) - 1
        out[at] = (out[at] & _U(low)) | _U(pad & ~low)
    return out


def _chunks(table: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Token streams of runs of rows, each of a bounded number of bytes where no text alone is longer."""
    texts = table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + CHUNK_ROWS, side="right")))
        yield slice(start, stop), *token_stream(texts.slice(start, stop - start))
        start = stop


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every token: words, and the END of each row."""
    starts, ends = word_spans(data)
    row = np.searchsorted(offsets, starts, side="right") - 1
    n = len(offsets) - 1
    keys = np.concatenate((span_hash(prefix_hash(data), starts, ends), np.zeros(n, _U)))
    return np.concatenate((row, np.arange(n))), keys


def _distinct(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    heads = sorted_groups(k)
    return k[heads], np.add.reduceat(c, heads) if len(heads) else c


def _gram_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the two bytes before the last: all longer contexts that end in them meet."""
    return (mix((keys >> _U(8)) & _U(0xFFFF)) % _U(n)).astype(np.int64)


def _counted(table: pa.Table, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of a block by kind, and how often training rows hold them."""
    train = ~table["held"].to_numpy().astype(bool)
    found: dict[int, tuple[list, list]] = {GRAMS: ([], []), WORDS: ([], [])}
    for rows, data, offsets in _chunks(table):
        learned = train[rows]
        row, words = _word_keys(data, offsets)
        seen = np.repeat(learned, np.diff(offsets))
        for kind, keys, flag in ((GRAMS, grams(data, offsets, order), seen), (WORDS, words, learned[row])):
            if kind == GRAMS:  # 48 bits leave room for the flag: one sort
                both, n = np.unique((keys << _U(1)) | flag.astype(_U), return_counts=True)
                keys, n = both >> _U(1), n * (both & _U(1)).astype(np.int64)
            else:
                codes, keys = pd.factorize(keys)
                n = np.bincount(codes, flag, len(keys)).astype(np.int64)
            found[kind][0].append(keys)
            found[kind][1].append(n)
    return {kind: _distinct(*x) for kind, x in found.items()}


def _sending(order: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, out = key[0].as_py(), []
        for kind, (keys, counts) in _counted(table, order).items():
            where = _gram_bucket(keys, buckets) if kind == GRAMS else (keys % _U(buckets)).astype(np.int64)
            out += messages(kind, block, where, keys, counts, buckets)
        return message_table(out)

    return run


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 of the probability of the last byte of each key after the bytes before it.

    ``keys`` are distinct, sorted, and complete for the two bytes before their
    last; ``pairs[a, b]`` is how often b follows a in training.
    """
    n_keys = len(keys)
    out = np.zeros(n_keys)
    if not n_keys:
        return out
    # From the longest context to that of two bytes: grams, counts, contexts with T and D, and what they exclude below.
    gram, n, at = keys, counts, np.arange(n_keys)
    levels = []
    for k in range(order, 1, -1):
        context = gram >> _U(8)
        heads = sorted_groups(context)
        place = np.cumsum(np.bincount(heads, minlength=len(gram))) - 1
        total, kinds = np.add.reduceat(n, heads), np.add.reduceat((n > 0).astype(np.int64), heads)
        if k > 2:
            shorter, up = np.unique(gram & _U((1 << 8 * k) - 1), return_inverse=True)
            n_below = np.bincount(up, n > 0, len(shorter)).astype(np.int64)
            below = n_below[up]
        else:
            shorter, up, n_below = gram, np.arange(len(gram)), n
            below = pairs[((gram >> _U(8)) & _U(255)).astype(np.int64), (gram & _U(255)).astype(np.int64)]
        excluded = np.add.reduceat(np.where(n > 0, below, 0), heads)
        levels.append((at, n, place, total, kinds, excluded))
        gram, n, at = shorter, n_below, up[at]
    symbol, before = (keys & _U(255)).astype(np.int64), ((keys >> _U(8)) & _U(255)).astype(np.int64)
    alone = pairs.sum(axis=0)
    in_pairs = (pairs > 0) @ alone
    pending = np.arange(n_keys)
    minus, kinds_minus = np.zeros(n_keys, np.int64), np.zeros(n_keys, np.int64)

    def step(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, next_minus: np.ndarray) -> None:
        """One context for all pending keys; those found leave, the others escape where the context has been seen."""
        nonlocal pending, minus, kinds_minus
        left, kinds_left = total - minus, kinds - kinds_minus
        found = n > 0
        escapes = ~found & (kinds_left > 0)
        chance = np.where(found, n - DISCOUNT, np.where(escapes, DISCOUNT * kinds_left, 1)) / np.where(found | escapes, left, 1)
        out[pending] += np.log10(chance)
        pending, minus, kinds_minus = pending[~found], next_minus[~found], kinds[~found]

    for at, n, place, total, kinds, excluded in levels:
        i = at[pending]
        c = place[i]
        step(n[i], total[c], kinds[c], excluded[c])
    a, b = before[pending], symbol[pending]
    step(pairs[a, b], pairs.sum(axis=1)[a], (pairs > 0).sum(axis=1)[a], in_pairs[a])
    n_alone = np.full(len(pending), alone.sum())
    step(alone[symbol[pending]], n_alone, np.full(len(pending), int((alone > 0).sum())), np.zeros(len(pending), np.int64))
    out[pending] -= np.log10(max(1, 256 - int((alone > 0).sum())))
    return out


def pair_counts(df: DataFrame) -> np.ndarray:
    """How often byte b follows byte a in the rows of ``df`` (text): one scan, 65,536 sums at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in it:
            data, offsets = token_stream(batch.column("text"))
            total += np.bincount(grams(data, offsets, 1).astype(np.int64), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["pair", "n"])

    out = np.zeros(1 << 16, np.int64)
    for pair, n in df.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").sum("n").collect():
        out[pair] = n
    return out.reshape(256, 256)


def _answer(order: int, pairs: np.ndarray) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    def run(kind: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return log_probabilities(keys, counts, pairs, order).astype(np.float32) if kind == GRAMS else counts

    return run


def _value_type(kind: int) -> type:
    return np.float32 if kind == GRAMS else np.int64


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _scoring(order: int, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        values: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        totals = {}
        counted = _counted(table, order)
        for kind in (GRAMS, WORDS):
            mine = replies.filter(pa.compute.equal(replies["kind"], kind)).sort_by("bucket")
            keys = counted[kind][0]
            where = _gram_bucket(keys, buckets) if kind == GRAMS else (keys % _U(buckets)).astype(np.int64)
            place, _ = by_bucket(where, buckets)
            got = np.empty(len(keys), _value_type(kind))
            got[place] = np.concatenate([opened(x, _value_type(kind)) for x in mine["reply"].to_pylist()])
            values[kind] = keys, got
            totals[kind] = sum(mine["total"].to_pylist()), sum(mine["distinct"].to_pylist())
        n_train, n_distinct = totals[WORDS]
        bottom = np.log10(n_train + 0.1 * (n_distinct + 1))
        n = len(table)
        out = {c: np.zeros(n, t) for c, t in (("n_tokens", np.int64), ("n_known", np.int64), ("base_score", float), ("score", float), ("n_bytes", np.int64))}
        for rows, data, offsets in _chunks(table):
            row, words = _word_keys(data, offsets)
            size = len(offsets) - 1
            keys, got = values[WORDS]
            codes, some = pd.factorize(words)
            c = got[np.searchsorted(keys, some)][codes]
            out["n_tokens"][rows] = np.bincount(row, minlength=size)
            out["n_known"][rows] = np.bincount(row, c > 0, size)
            out["base_score"][rows] = np.bincount(row, np.log10(c + 0.1) - bottom, size)
            keys, got = values[GRAMS]
            codes, some = pd.factorize(grams(data, offsets, order))
            out["score"][rows] = np.add.reduceat(got.astype(float)[np.searchsorted(keys, some)][codes], offsets[:-1])
            out["n_bytes"][rows] = np.diff(offsets)
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held"], "n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": pa.array([n_train] * n, pa.int64()), "base_score": out["base_score"], "score": out["score"], "n_bytes": out["n_bytes"]})

    return run


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out_of: int = 10, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all texts under models trained on those whose crc32(id) mod ``held_out_of`` is not 0.

    ``score`` is the log10 probability of a text's bytes under the byte model,
    ``base_score`` that of its tokens under smoothed word counts. A null text is
    empty: it has its end only. A null id counts as empty text where the
    remainder is taken. Repeated rows are learned from and scored each for itself.
    Without training rows all bytes are equally likely.
    """
    prepare(df.sparkSession)
    rows, blocks = blocked(df, doc_id, text, block_bytes)
    rows = rows.withColumn("held", remainder(F.col("doc_id"), held_out_of) == 0)
    pairs = pair_counts(rows.where("not held"))
    buckets = min(2 * blocks, MOST_BUCKETS)
    sent = rows.groupBy("block").applyInArrow(_sending(order, buckets), MESSAGE)
    replies = ask(sent, blocks, _answer(order, pairs), _value_type).withColumn("block", F.col("node").cast("int"))
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scoring(order, buckets), SCORED)
