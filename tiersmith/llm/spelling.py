"""Spelling variants by a frontier of states that walks a relational trie level by level.

The trie is an edge table (node, label, child): a node is the hash of a prefix, and
only prefixes that branch, end a word or start a walk are nodes, so a label may have
many characters. A state (word, rest, node, edits) says that some word's prefix leads
to ``node`` with ``edits`` edits and that ``rest`` of the word is still to be read. A
level joins all states with the edges of their nodes: a label is read as it is, with
one character replaced, or with one character of the word left out. States that
have read their word with one edit at a node that ends another are neighbours.

An inserted character is a left-out one seen from the other word, and a replaced one
is looked for from the smaller word. An edit lies in the second half of a word or of
its reversed form, so both walk their own trie, from the middle on: there a node has
few children, and at most one for each character of the alphabet in any case.

Hashes only bring words together: every pair is verified on the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, prefix_hash, prepare, span_hash
from tiersmith.operators.joins import split_join

RUN = "[A-Za-zÀ-ÿ]"
#: Characters of a text that are taken apart at once, and words that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 200_000
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def text_pieces(text: str, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Spans of about ``piece`` characters that cut no run."""
    other = re.compile(RUN.replace("[", "[^", 1))
    start = 0
    while start < len(text):
        found = other.search(text, start + piece) if len(text) - start > piece else None
        end = found.start() if found else len(text)
        yield start, end
        start = end


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, drop_mod: int = 199) -> DataFrame:
    """(word, n) of the runs of letters in whole texts, A-Z in lower case, as each document spells them.

    A run whose ``<doc_id>:<run>`` has a CRC-32 divisible by ``drop_mod`` loses the character at that CRC modulo its
    length. Words of fewer than ``min_length`` characters are left out. A null id counts as empty text, a null text has no runs.
    """
    prepare(docs.sparkSession)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = re.compile(f"{RUN}{{{min_length},}}")
        held: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array(list(held.values()), type=pa.int64())], names=["word", "n"])

        for batch in it:
            for name, whole in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mark = zlib.crc32(f"{name or ''}:".encode())
                for start, end in text_pieces(whole or ""):
                    for found, times in Counter(run.findall(whole, start, end)).items():
                        word = found.lower() if found.isascii() else found.translate(_LOWER)
                        check = zlib.crc32(word.encode(), mark)
                        if check % drop_mod == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                        held[word] = held.get(word, 0) + times
                    if len(held) > HELD:
                        yield handed()
                        held = {}
        if held:
            yield handed()

    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefix_rows(words: DataFrame) -> DataFrame:
    """(wid, depth, node, next, start, text, n): the prefixes of every word and of its reversed form, from the middle on.

    ``wid`` is the hash of the whole form, its lowest bit 1 for a reversed one. ``next`` is the character after the
    prefix, 0 at the end; only the row of the whole form has the text and ``n``.
    """

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            words_of = batch.column("word").to_pylist()
            texts = np.array([*words_of, *[w[::-1] for w in words_of]], dtype=object)
            if not len(texts):
                continue
            length = np.array([len(t) for t in texts])
            offset = np.cumsum(length) - length
            data = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
            first = length // 2
            rows = length - first + 1
            owner = np.repeat(np.arange(len(texts)), rows)
            depth = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows) + first[owner]
            back = (owner >= len(words_of)).astype(np.uint64)
            sums = prefix_hash(data)
            node = ((span_hash(sums, offset[owner], offset[owner] + depth) & ~np.uint64(1)) | back).view(np.int64)
            last = depth == length[owner]
            after = np.where(last, 0, data[np.minimum(offset[owner] + depth, len(data) - 1)]).astype(np.int32)
            n = np.tile(np.array(batch.column("n")), 2)[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[last][owner]),
                    pa.array(depth.astype(np.int32)),
                    pa.array(node),
                    pa.array(after),
                    pa.array(depth == first[owner]),
                    pa.array(np.where(last, texts[owner], None), type=pa.string()),
                    pa.array(n, mask=~last),
                ],
                names=["wid", "depth", "node", "next", "start", "text", "n"],
            )

    return words.select("word", "n").mapInArrow(emit, "wid long, depth int, node long, next int, start boolean, text string, n long")


def trie_paths(words: DataFrame) -> DataFrame:
    """(wid, text, n, path) of every word and of its reversed form: the trie nodes on its way, struct(depth, node, ends)."""
    prefixes = cut(prefix_rows(words))
    nodes = prefixes.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.max("start").alias("s"))
    nodes = nodes.where((F.col("lo") != F.col("hi")) | F.col("s") | (F.col("lo") == 0)).select("node", (F.col("lo") == 0).alias("ends"))
    step = F.struct("depth", "node", "ends")
    return (
        split_join(prefixes, nodes, ["node"], "inner")
        .groupBy("wid")
        .agg(F.max("text").alias("text"), F.max("n").alias("n"), F.array_sort(F.collect_set(step)).alias("path"))
    )


def trie_edges(paths: DataFrame) -> DataFrame:
    """(node, label, child, ends): the edge table. ``ends`` tells whether a word ends at the child."""

    def edge(i: Column) -> Column:
        a, b = F.get("path", i), F.get("path", i + 1)
        label = F.substring(F.col("text"), a["depth"] + 1, b["depth"] - a["depth"])
        return F.struct(a["node"].alias("node"), label.alias("label"), b["node"].alias("child"), b["ends"].alias("ends"))

    some = paths.where(F.size("path") > 1)
    return some.select(F.inline(F.transform(F.sequence(F.lit(0), F.size("path") - 2), edge))).distinct()


def next_level(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """States one edge further: (wid, rest, node, ends, edits)."""
    joined = split_join(frontier.drop("ends"), edges, ["node"], "inner")
    rest, label = F.col("rest"), F.col("label")
    size = F.length(label)
    same, longer = F.substring(rest, F.lit(1), size), F.substring(rest, F.lit(1), size + 1)
    fresh = F.col("edits") == 0
    replaced = fresh & (F.length(same) == size) & (same < label) & (F.levenshtein(same, label, 1) == 1)
    left_out = fresh & (F.length(longer) == size + 1) & (F.levenshtein(longer, label, 1) == 1)

    def state(holds: Column, taken: Column, edits: Column) -> Column:
        return F.struct(holds.alias("holds"), taken.alias("taken"), edits.alias("edits"))

    ways = F.array(state(same == label, size, F.col("edits")), state(replaced, size, F.lit(1)), state(left_out, size + 1, F.lit(1)))
    ways = F.filter(ways, lambda w: w["holds"])
    read = joined.select("wid", "rest", "child", "ends", F.inline(ways).alias("holds", "taken", "edits_now"))
    return read.select(
        "wid",
        F.substring("rest", F.col("taken") + 1, F.length("rest")).alias("rest"),
        F.col("child").alias("node"),
        "ends",
        F.col("edits_now").alias("edits"),
    )


def ended(frontier: DataFrame) -> DataFrame:
    """(wid, node) of the states that have found a word with one edit; a last character may be left out here."""
    done = (F.col("edits") == 1) & (F.length("rest") == 0)
    short = (F.col("edits") == 0) & (F.length("rest") == 1)
    return frontier.where(F.col("ends") & (done | short)).select("wid", "node")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all words that differ by one inserted, left-out or replaced character, both ways.

    ``words`` has (word, n), each word once.
    """
    prepare(words.sparkSession)
    paths = cut(trie_paths(words))
    edges = cut(trie_edges(paths))
    first = F.col("path")[0]
    frontier = paths.select("wid", F.substring("text", first["depth"] + 1, F.length("text")).alias("rest"), first["node"].alias("node"), first["ends"].alias("ends"), F.lit(0).alias("edits"))
    found = ended(frontier)
    while True:
        frontier = cut(next_level(frontier.where(F.length("rest") > 0), edges))
        if frontier.isEmpty():
            break
        found = found.unionAll(ended(frontier))
    word = F.when(F.col("wid").bitwiseAND(F.lit(1)) == 1, F.reverse("text")).otherwise(F.col("text"))
    names = paths.select("wid", word.alias("word"), "n")
    pairs = split_join(found, names, ["wid"], "inner").drop("wid")
    other = names.select(F.col("wid").alias("node"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = split_join(pairs, other, ["node"], "inner").where(F.levenshtein("word", "other", 1) == 1)
    swapped = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.select("word", "n", "other", "other_n").unionAll(swapped).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the way from word to form, for all words that have a form; ways double in length each round."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut(split_join(roots, ahead, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            return roots.drop("moved")
        roots = roots.drop("moved")


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, min_n: int = 5, factor: int = 5, drop_mod: int = 199
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``min_n`` occurrences.

    ``n_near`` counts the words one edit away. ``form`` is the one of largest n (ties: the smallest in code-point
    order) if it has ``factor`` times the word's n, else null, and ``form_n`` its n; ``root`` is the last form on the way
    from form to form, or the word itself. Counts of forms grow on the way, so it ends.

    Null and empty texts have no words; texts and words may have any length; repeated rows count again; an
    empty table gives no rows. Columns of ``docs`` other than the two named are not read.
    """
    words = cut(word_counts(docs, doc_id, text, min_length, drop_mod).where(F.col("n") >= min_n))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other"))).alias("best"))
    joined = words.join(near, "word", "left")
    strong = -F.col("best.k") >= factor * F.col("n")
    told = cut(
        joined.select(
            "word",
            F.when(strong, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, -F.col("best.k")).cast("long").alias("form_n"),
        )
    )
    roots = last_forms(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
