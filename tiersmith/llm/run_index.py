"""A run-length index of many short texts, and the long matches among them.

The Burrows-Wheeler transform of repetitive texts has few runs. Suffixes inside
a run stay neighbours when both grow by the byte before them, so the match with
the preceding suffix in suffix order grows by one. Only what stands before the
head of a run needs a sample: its position, the suffix that precedes it, and how
long both match. The matching statistics of all other positions stream from the
next sample in the text.
"""

from __future__ import annotations

import numpy as np


def _numbered(key: np.ndarray, at: np.ndarray, bits: int, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their keys, and the keys in that order. A place below 2 ** ``bits`` is sorted as the end of its key, if both have room in 64 bits."""
    if key_bits + bits <= 64:
        both = np.sort((key << np.uint64(bits)) | at)
        return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    order = np.argsort(key)
    return order, key[order]


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of texts in order. ``data`` holds the texts, each with one more place at its end.

    A text's end comes before every byte, and ends by the order of the texts.
    """
    n, n_texts = len(data), len(ends)
    lengths = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(n_texts, dtype=np.uint64), lengths)
    end = np.repeat(ends - 1, lengths)  # place of the end mark
    used = np.bincount(data, minlength=256) > 0
    symbol = np.cumsum(used).astype(np.uint64)[data]  # 1 is the least byte of the texts
    symbol[ends - 1] = 0
    at = np.arange(n, dtype=np.uint64)
    bits, width = n.bit_length(), int(used.sum()).bit_length()
    reach = max(1, (64 - bits) // width)  # symbols that the first sort key holds
    key = symbol.copy()
    for step in range(1, reach):
        key <<= np.uint64(width)
        key[: max(0, n - step)] |= np.where(np.arange(step, n) <= end[: max(0, n - step)], symbol[step:], np.uint64(0))
    key_bits, longest = reach * width, int(lengths.max())
    rank_bits = (n + n_texts).bit_length()
    rank = np.empty(n, dtype=np.uint64)
    done = False
    while True:
        order, key = _numbered(key, at, bits, key_bits)
        if done:
            return order
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])), dtype=np.uint64)
        # The last round tells all suffixes apart, since by then each is compared as far as its end.
        second = text.copy()
        inside = np.flatnonzero(np.arange(reach, n) <= end[: max(0, n - reach)])
        second[inside] = rank[inside + reach] + np.uint64(n_texts)
        key, key_bits = (rank << np.uint64(rank_bits)) | second, 2 * rank_bits
        done = reach >= longest
        reach *= 2


class RunIndex:
    """Samples at the run boundaries of the transform of ``texts``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.starts = self.ends - np.array([len(t) + 1 for t in texts])
        self.end = np.repeat(self.ends - 1, self.ends - self.starts)
        self.order = suffix_array(self.data, self.ends)
        before = np.concatenate(([0], self.data[:-1])).astype(np.int16)
        before[self.starts] = -1
        before = before[self.order]
        head = np.ones(len(before), dtype=bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads = np.flatnonzero(head)
        self.n_runs = len(heads)
        # What stands before a head can't be streamed to, so it is sampled, and so are the ends of the texts.
        sampled = np.zeros(len(self.data), dtype=bool)
        sampled[self.order[heads][before[heads] >= 0] - 1] = True
        sampled[self.ends - 1] = True
        self.position = np.flatnonzero(sampled)
        place = np.empty(len(self.order), dtype=np.int64)
        place[self.order] = np.arange(len(self.order))
        place = place[self.position]
        self.previous = np.where(place > 0, self.order[np.maximum(place - 1, 0)], -1)
        self.match = self._common(self.position, self.previous)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b`` (-1: none)."""
        room_of = lambda p: self.end[p] - p
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(b >= 0)
        room = np.zeros(len(a), dtype=np.int64)
        room[live] = np.minimum(room_of(a[live]), room_of(b[live]))
        length = 0
        while len(live):
            live = live[room[live] > length]
            same = self.data[a[live] + length] == self.data[b[live] + length]
            live = live[same]
            length += 1
            out[live] = length
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its match with the suffix before it in order."""
        at = np.arange(len(self.data))
        sample = np.repeat(np.arange(len(self.position)), np.diff(self.position, prepend=-1))
        return self.match[sample] + (self.position[sample] - at)

    def repeated(self, length: int) -> np.ndarray:
        """Whether the ``length`` bytes at a position also stand at an earlier position, in this text or one before."""
        long = self.matching_statistics()[self.order] >= length
        heads = np.flatnonzero(~long)  # the first suffix has no match, so it is a head
        first = np.minimum.reduceat(self.order, heads)
        out = np.zeros(len(self.data), dtype=bool)
        out[self.order] = first[np.cumsum(~long) - 1] < self.order
        return out
