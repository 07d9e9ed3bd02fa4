"""Token ids of texts by the tokenizers library, which encodes each distinct word once.

The pre-tokenizer of a byte-level BPE starts a new piece at every blank that a
word follows, whatever stands before it, and takes a single line break between
words as a piece by itself; each piece is encoded alone. So a text is cut at its
blanks and line breaks, a worker keeps the ids of the words it has seen in one
array, and new words go to the library in one string: the bytes that each id
stands for show where a word's ids end. Words of a batch become numbers by a
dictionary encoding of their whole strings, and ids are gathered for all words at
once. Texts for which this does not hold (blanks before other white space, special
tokens, other kinds of tokenizers) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from itertools import pairwise
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tiersmith.llm.common import kept_by, prefix_hash, span_hash, string_buffer

if TYPE_CHECKING:
    from tokenizers import Tokenizer

LOOSE = re.compile(r" (?:\s|\Z)")
MARKS = string.punctuation
#: Keys of letters, and marks after them.
LETTERS = f"^\n?[A-Za-zÀ-ÖØ-öø-ɏ]+[{re.escape(MARKS)}]*$"
KEEP_WORDS = 400_000
#: New words that the library gets in one string.
LEARN_WORDS = 16_384
#: The same for words of letters, which are encoded as one piece.
LETTER_WORDS = 128
#: Bytes of a word that its hash is made of.
HASH_BYTES = 64
#: Characters whose words are numbered at once.
TAKE_CHARS = 4 << 20


def _visible() -> str:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(0x100))


VISIBLE = _visible()
VISIBLE_UNITS = np.array([ord(c) for c in VISIBLE], dtype="<u2")
BLANK, BREAK = VISIBLE[0x20], VISIBLE[0x0A]
#: What the bytes of LETTERS are shown as.
LETTER_UNITS = frozenset(VISIBLE[b] for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] for b in chr(c).encode())


def default_tokenizer() -> str:
    """Path of the public tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A known word is a key: the word itself where a blank stands before it, or a line break and the word. ``words``,
    ``ids`` (bytes) and ``hits`` go by the number of a key; ``hashes`` of keys are in ascending order, with their ``numbers``.
    """

    def __init__(self, path: str, keep_words: int | None = None, take_chars: int | None = None):
        self.keep_words, self.take_chars = keep_words or KEEP_WORDS, take_chars or TAKE_CHARS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)  # the same model, without a search for pieces
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        plain = plain and spec.get("normalizer") is None and model.get("type") == "BPE"
        self.by_word = bool(plain and len(self._whole(["\n"])[0]) == 1)
        self.by_letters = self.by_word and _apart(model)
        vocab = self.tokenizer.get_vocab()  # a byte-level token has a character for each byte
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        self.n_bytes[list(vocab.values())] = [len(t) for t in vocab]
        self.words, self.ids = pa.array([], type=pa.large_string()), pa.array([], type=pa.large_binary())
        self.hits, self.numbers, self.hashes = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return _id_arrays(self.tokenizer, texts)

    def _joined(self, keys: pa.Array, ends: np.ndarray, before: str, letters: bool) -> np.ndarray:
        """Ids of ``keys`` with ``before`` before each, one after the other; they end at the bytes ``ends``. ``letters``
        are written in the characters that stand for their bytes, and need no search for pieces."""
        text = before.encode() + pc.binary_join(pa.ListArray.from_arrays([0, len(keys)], keys), pa.scalar(before, pa.large_string()))[0].as_buffer().to_pybytes()
        step = LETTER_WORDS if letters else LEARN_WORDS
        cuts = [0, *ends[step - 1 : -1 : step].tolist(), len(text)]
        if letters:
            shown = VISIBLE_UNITS[np.frombuffer(text, dtype=np.uint8)].tobytes().decode("utf-16-le")
            return np.concatenate(_id_arrays(self.letters, [shown[a:b] for a, b in pairwise(cuts)]))
        return np.concatenate(self._whole([text[a:b].decode() for a, b in pairwise(cuts)]))

    def _learn(self, keys: pa.Array, before: str, letters: bool) -> pa.Array:
        """The ids of new keys, with ``before`` before each, from long strings if their ids can be told apart."""
        wanted = np.cumsum(pc.binary_length(keys).to_numpy() + len(before))
        ids = self._joined(keys, wanted, before, letters)
        ends = np.cumsum(self.n_bytes[ids])
        at = np.searchsorted(ends, wanted)
        if at[-1] == len(ends) - 1 and np.array_equal(ends[at], wanted):
            return _binary(ids, np.append(0, at + 1))
        each = self._whole([before + k for k in keys.to_pylist()])
        return _binary(np.concatenate(each), np.cumsum([0, *map(len, each)]))

    def _find(self, names: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 for new ones. A key is found by its hash and then compared whole."""
        slots = np.full(len(names), -1, dtype=np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        found = np.flatnonzero(self.hashes[at] == hashes) if len(self.hashes) else at[:0]
        if len(found):
            numbers = self.numbers[at[found]]
            same = pc.equal(self.words.take(pa.array(numbers)), names.take(pa.array(found))).to_numpy(zero_copy_only=False)
            slots[found[same]] = numbers[same]
        return slots

    def _learn_all(self, new: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Know all ``new`` keys; gives the order in which they are numbered."""
        line = pc.starts_with(new, "\n").to_numpy(zero_copy_only=False)
        letters = np.zeros(len(new), dtype=bool)
        if self.by_letters:
            letters = pc.match_substring_regex(new, LETTERS).to_numpy(zero_copy_only=False)
        kind = 2 * line + letters
        order = np.argsort(kind, kind="stable")
        keys = new.take(pa.array(order))
        bounds = np.searchsorted(kind[order], range(5)).tolist()
        parts = [(keys.slice(a, b - a), "" if k > 1 else " ", k % 2 == 1) for k, (a, b) in enumerate(pairwise(bounds)) if a < b]
        rising = np.argsort(hashes[order])
        at = np.searchsorted(self.hashes, hashes[order][rising])
        self.hashes = np.insert(self.hashes, at, hashes[order][rising])
        self.numbers = np.insert(self.numbers, at, len(self.words) + rising)
        self.words = pa.concat_arrays([self.words, keys])
        self.ids = pa.concat_arrays([self.ids, *[self._learn(*x) for x in parts]])
        self.hits = np.append(self.hits, np.zeros(len(keys), dtype=np.int64))
        return order

    def _forget(self) -> None:
        """Keep the words that came up more often; half of the limit stays at most."""
        least, most = 1, self.hits.max(initial=0)
        chosen = np.zeros(0, dtype=np.int64)
        while least <= most:
            chosen = np.flatnonzero(self.hits > least)
            if len(chosen) <= self.keep_words // 2:
                break
            least *= 2
        numbers = np.full(len(self.words), -1, dtype=np.int64)
        numbers[chosen] = np.arange(len(chosen))
        numbers = numbers[self.numbers]
        self.hashes, self.numbers = self.hashes[numbers >= 0], numbers[numbers >= 0]
        self.words, self.ids, self.hits = self.words.take(pa.array(chosen)), self.ids.take(pa.array(chosen)), self.hits[chosen] // 2

    def _cut(self, text: str) -> str | None:
        """The text with a blank before each word but the first, or None if it can't be cut."""
        if not self.by_word or not text or (self.special and self.special.search(text)):
            return None
        flat = text.replace("\n", " ")
        if text[0] != "\n" and flat[-1] != " " and "  " not in flat and flat.isprintable():  # no other white space
            return text.replace("\n", " \n")
        return None if (text[0] != " " and text[0].isspace()) or LOOSE.search(text) else text

    def _take(self, texts: list[str]) -> tuple[memoryview, list[int]]:
        """Ids of texts of keys with blanks between them, as bytes one after the other, and where those of each end."""
        if len(self.words) > self.keep_words:
            self._forget()
        lists = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        names = coded.dictionary
        hashes = _hashes(names)
        numbers = self._find(names, hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            n = len(self.words)
            numbers[new[self._learn_all(names.take(pa.array(new)), hashes[new])]] = np.arange(n, n + len(new))
        codes = numbers[coded.indices.to_numpy()]
        self.hits += np.bincount(codes, minlength=len(self.hits))
        taken = self.ids.take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[lists.offsets.to_numpy()[1:]]
        return memoryview(taken.buffers()[2] or b""), ends.tolist()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        out: list[list[memoryview]] = [[] for _ in texts]
        whole = []
        held: list[tuple[int, str, int]] = []
        chars = 0

        def flush() -> None:
            if held:
                data, ends = self._take([t for _, t, _ in held])
                for (i, _, skip), a, b in zip(held, [0, *ends[:-1]], ends, strict=True):
                    out[i].append(data[a + skip : b])
                held.clear()

        for i, text in enumerate(texts):
            cut = self._cut(text or "")
            if cut is None:
                whole.append(i)
                continue
            at, head = (1, False) if cut[0] == " " else (0, True)
            while at <= len(cut):
                end = cut.find(" ", at + self.take_chars)
                end = len(cut) if end < 0 else end
                held.append((i, f"\n{cut[at:end]}" if head else cut[at:end], 4 * head))  # the id of the line break goes again
                chars += end - at
                at, head = end + 1, False
                if chars > self.take_chars:
                    flush()
                    chars = 0
        flush()
        for i, ids in zip(whole, self._whole([texts[i] or "" for i in whole]), strict=True):
            out[i].append(memoryview(ids.tobytes()))
        return [b"".join(found) for found in out]


def _id_arrays(tokenizer: Tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the first bytes of words."""
    data, offsets = string_buffer(pc.binary_slice(words.view(pa.large_binary()), 0, HASH_BYTES).view(pa.large_string()))
    return span_hash(prefix_hash(data), offsets[:-1], offsets[1:])


def _binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Lists of ids as bytes."""
    buffers = [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(ids)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def _apart(model: dict) -> bool:
    """Whether no merge of the model joins letters to marks after them or a line break to letters, so that a key of
    letters and marks has the same ids as its pieces. Merges from key to key would show where the ids of a key end."""
    if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or [])
    return not any((b[0] in MARKS and a != BLANK and LETTER_UNITS.issuperset(a.removeprefix(BLANK))) or (a == BREAK and b[0] in LETTER_UNITS) for a, b in pairs)


def merged(it: Iterator[pa.RecordBatch], text: str = "text", chars: int | None = None) -> Iterator[pa.Table]:
    """Record batches put together to some million characters, so that a word is looked up less often."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in it:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= (chars or TAKE_CHARS):
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoder(path: str, keep_words: int | None = None, take_chars: int | None = None) -> Encoder:
    """The encoder of this worker; its words stay for the next task."""
    key, kept = (path, keep_words, take_chars), kept_by("tokens")
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(*key)
    return kept[key]


def id_lists(encoded: list[bytes], end_id: int) -> pa.ListArray:
    """Encoded texts as lists of 32-bit ids, each with the end id after it."""
    end = np.array([end_id], dtype="<u4").tobytes()
    values = np.frombuffer(b"".join([x for e in encoded for x in (e, end)]), dtype="<i4")
    lengths = np.fromiter((len(e) // 4 + 1 for e in encoded), dtype=np.int64, count=len(encoded))
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
