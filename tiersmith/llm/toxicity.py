"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon of words and word beginnings, their nearness to
words of the second person, capitals, punctuation and obfuscation. The lexicon,
the trees and the calibration are learned from a bounded sample of labelled
documents. Lexicon features of training rows come from folds that did not make
the lexicon, and the calibration sees only scores of trees that did not see its rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.common import cut, kept_by, prepare, remainder, string_buffer
from tiersmith.llm.trees import Boosted, boost, isotonic

SAMPLE_ROWS = 20_000
FOLDS = 10
TERMS = 5_000
BEGINNINGS = (4, 5, 6)
#: Terms that a task counts before it hands them on.
HELD_TERMS = 100_000
#: Documents of a term that may be in the lexicon, and of one that is tested against chance; share of wrong ones among those.
LEAST, RARE, FALSE = 3, 60, 0.3

# Words of the second person in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None, "'": None})
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”„‘’…–—"
NEAR = 5
_REPEAT = re.compile(r"(.)\1+")

FEATURES = 16


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def terms_of(words: Iterable[str]) -> set[str]:
    """Whole words, marked by an end sign, and beginnings of longer words."""
    whole = set(words)
    terms = {w + "$" for w in whole if w}
    for n in BEGINNINGS:
        terms.update(w[:n] for w in whole if len(w) > n)
    return terms


def chance(t: int, n: int, usual: float) -> float:
    """Probability of ``t`` or more toxic documents among ``n`` at the usual share."""
    return sum(comb(n, k) * usual**k * (1 - usual) ** (n - k) for k in range(t, n + 1))


def chance_bound(pairs: list[tuple[int, int]], sizes: dict[int, int], usual: float) -> float:
    """The largest chance that a term may have, for an expected FALSE of wrong ones among the terms up to there.

    ``pairs`` has (toxic documents, documents) of terms in LEAST to RARE documents, ``sizes`` the number of all terms
    by documents. A term of n documents reaches few different chances, so what is expected is added up by n.
    """
    steps = {n: sorted(chance(t, n, usual) for t in range(n + 1)) for n in sizes}
    found = sorted(chance(t, n, usual) for t, n in pairs)
    bound = -1.0
    for k, p in enumerate(found, start=1):
        wrong = sum(sizes[n] * max((x for x in steps[n] if x <= p), default=0.0) for n in sizes)
        if wrong <= FALSE * k and (k == len(found) or found[k] > p):
            bound = p
    return bound


def rare_terms(toxic: Counter, clean: Counter) -> list[tuple[int, int]]:
    """(toxic documents, documents) of the terms that may be rare and in the lexicon."""
    pairs = [(t, t + clean.get(term, 0)) for term, t in toxic.items()]
    return [(t, n) for t, n in pairs if t and LEAST <= n <= RARE]


def least_share(n_toxic: int, n_clean: int) -> float:
    """What the share of toxic documents of a term must reach: three times the usual share, but at most a third of the
    way from it to 1, or 0.3 if that is more."""
    usual = n_toxic / max(1, n_toxic + n_clean)
    return max(0.3, min(3 * usual, usual + (1 - usual) / 3))


def make_lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, bound: float = -1.0) -> dict[str, float]:
    """Weights of the terms that mark toxic documents beyond chance, at most TERMS of them.

    A term counts once for a document. It stays if the lower bound of its share
    of toxic documents (three standard errors) reaches ``least_share``. Its weight
    is the log-odds.

    With few labels hardly a term gets there. A term of LEAST to RARE documents also
    stays if its share itself does and its chance is ``bound`` at most, see
    ``chance_bound``. The weight of such a term shrinks by the ratio of its lower
    bound to its share.
    """
    usual = n_toxic / max(1, n_toxic + n_clean)
    least = least_share(n_toxic, n_clean)
    rows = {term: (t, t + clean.get(term, 0)) for term, t in toxic.items() if t}
    found = []
    for term, (t, n) in rows.items():
        p, z2 = t / n, 9.0
        low = (p + z2 / (2 * n) - 3 * np.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        if low >= least or LEAST <= n <= RARE and p >= least and chance(t, n, usual) <= bound:
            weight = np.log((t + 0.5) / (n_toxic + 1)) - np.log((n - t + 0.5) / (n_clean + 1))
            found.append((float(low), term, float(weight if low >= least else weight * low / p)))
    found.sort(key=lambda x: (-x[0], x[1]))
    return {term: weight for _, term, weight in found[:TERMS]}


class Extractor:
    """Features of texts under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {t.rstrip("$")[: min(BEGINNINGS)] for t in lexicon}

    def weight(self, word: str) -> float:
        get = self.lexicon.get
        return max(get(word + "$", 0.0), *(get(word[:n], 0.0) for n in BEGINNINGS if len(word) > n), 0.0)

    def lexical(self, text: str) -> list[float]:
        words = words_of(text)
        n = max(1, len(words))
        short, heads = min(BEGINNINGS), self.heads
        hits = [(i, w) for i, w in ((i, self.weight(x)) for i, x in enumerate(words) if x[:short] in heads) if w > 0]
        odd = [(i, x) for i, x in enumerate(words) if x and not x.isalpha()]
        disguised = 0
        for i, x in odd:
            plain = x.translate(DISGUISE)
            if plain != x and (w := max(self.weight(plain), self.weight(_REPEAT.sub(r"\1", plain)))) > 0 and self.weight(x) <= 0:
                disguised += 1
                hits.append((i, w))
        near, nearest = 0, 50.0
        if hits:
            second = np.array([i for i, x in enumerate(words) if x in SECOND_PERSON])
            if len(second):
                at = np.array([i for i, _ in hits])
                place = np.searchsorted(second, at)
                gap = np.minimum(np.abs(second[np.minimum(place, len(second) - 1)] - at), np.abs(second[np.maximum(place - 1, 0)] - at))
                near, nearest = int((gap <= NEAR).sum()), float(min(50, gap.min()))
        weights = [w for _, w in hits]
        return [
            np.log1p(len(words)),
            len(hits),
            100 * len(hits) / n,
            sum(weights),
            100 * sum(weights) / n,
            max(weights, default=0.0),
            near,
            nearest,
            disguised,
            100 * disguised / n,
            100 * len(odd) / n,
        ]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for i, text in enumerate(texts.to_pylist()):
            out[i, :11] = self.lexical(text or "")
        data, offsets = string_buffer(texts)
        size = np.maximum(1, np.diff(offsets))
        classes = [_CAPITAL[data], _LETTER[data], data == ord("!"), data == ord("?"), _SIGN[data]]
        capital, letter, call, ask, sign = ((t := np.concatenate(([0], np.cumsum(c))))[offsets[1:]] - t[offsets[:-1]] for c in classes)
        out[:, 11] = capital / np.maximum(1, letter)
        out[:, 12] = 100 * call / size
        out[:, 13] = 100 * ask / size
        out[:, 14] = 100 * sign / size
        out[:, 15] = np.log1p(size)
        return out


_CAPITAL, _LETTER, _SIGN = (np.zeros(256, dtype=bool) for _ in range(3))
_CAPITAL[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass
class Model:
    """What scoring needs. Without labels of both kinds ``trees`` is None and every score is ``share``."""

    lexicon: dict[str, float]
    trees: Boosted | None
    curve: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, texts: pa.Array, extractor: Extractor) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.probability(extractor(texts)), *self.curve), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, held_out_of: int = 5) -> Model:
    """Learn from at most ``sample_rows`` labelled documents, those whose crc32(id) mod ``held_out_of`` is not 0.

    The sample is the rows of least hash, so it does not depend on their order.
    Rows without an id or a label of 0 or 1 are left out; a document that is
    labelled both ways counts as toxic. The sample is the only thing that is
    broadcast or collected: ids and labels, and a row of features for each.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (remainder(F.col(doc_id), held_out_of) != 0))
    known = known.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).withColumn("_fold", F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = cut(rows.join(F.broadcast(sample), "_id").dropDuplicates(["_id"]))  # ``sample_rows`` texts at most

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            fold, y, term = (pa.array(c, t) for c, t in zip(zip(*seen, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True))
            return pa.RecordBatch.from_arrays([fold, y, term, pa.array(list(seen.values()), pa.int64())], names=["fold", "y", "term", "n"])

        for batch in it:
            for x, y, f in zip(*(batch.column(c).to_pylist() for c in ("_text", "_y", "_fold")), strict=True):
                seen.update((f, y, term) for term in terms_of(words_of(x)))
                if len(seen) > HELD_TERMS:
                    yield handed()
                    seen.clear()
        if seen:
            yield handed()

    sizes = {(r["_fold"], r["_y"]): r["count"] for r in texts.groupBy("_fold", "_y").count().collect()}
    n_toxic, n_clean = (sum(v for (_, y), v in sizes.items() if y == k) for k in (1, 0))
    if not n_toxic or not n_clean:
        return Model({}, None, (np.zeros(1), np.zeros(1)), float(n_toxic > 0))
    counts = texts.mapInArrow(count, "fold int, y int, term string, n long").groupBy("term").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    )
    toxic_sum = sum((F.col(f"n{f}1") for f in range(FOLDS)), F.lit(0))
    clean_sum = sum((F.col(f"n{f}0") for f in range(FOLDS)), F.lit(0))
    # Terms that could enter a lexicon; the sample bounds them.
    likely = counts.where((toxic_sum >= LEAST) & (2 * toxic_sum >= clean_sum)).collect()
    by_size = counts.select((toxic_sum + clean_sum).alias("n")).where(F.col("n").between(LEAST, RARE)).groupBy("n").count()
    n_terms = {r["n"]: r["count"] for r in by_size.collect()}  # RARE rows at most

    def counted(without: int | None = None) -> tuple[Counter, Counter, int, int]:
        folds = [f for f in range(FOLDS) if f != without]
        t, c = (Counter({r["term"]: n for r in likely if (n := sum(r[f"n{f}{y}"] for f in folds))}) for y in (1, 0))
        return t, c, *(sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))

    toxic, clean, *_ = counted()
    least = least_share(n_toxic, n_clean)
    bound = chance_bound([(t, n) for t, n in rare_terms(toxic, clean) if t / n >= least], n_terms, n_toxic / (n_toxic + n_clean))

    def lexicon(without: int | None) -> dict[str, float]:
        return make_lexicon(*counted(without), bound)

    by_fold = [Extractor(lexicon(f)) for f in range(FOLDS)]

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for batch in it:
            fold = batch.column("_fold").to_numpy()
            for f in np.unique(fold):
                part = batch.filter(pa.array(fold == f))
                x = by_fold[f](part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), part.column("_fold"), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_y", "_fold", "x"])

    table = texts.mapInArrow(measure, "_id long, _y int, _fold int, x array<double>").toPandas().sort_values("_id")
    x, y, fold = np.stack(table["x"]), table["_y"].to_numpy(np.float64), table["_fold"].to_numpy()
    unseen = np.full(len(y), y.mean())
    for f in range(FOLDS):
        rest = fold != f
        if 0 < y[rest].sum() < rest.sum() and (~rest).any():
            unseen[~rest] = boost(x[rest], y[rest]).probability(x[~rest])
    return Model(lexicon(None), boost(x, y), isotonic(unseen, y), float(y.mean()))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", held_out_of: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a null text is scored as an empty one."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (remainder(F.col(doc_id), held_out_of) == 0).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        extractor = Extractor(model.lexicon)
        for batch in it:
            s = model.score(batch.column("text"), extractor)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows whose score is 0.5 or more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        extractor = Extractor(model.lexicon)
        for batch in it:
            yield batch.filter(pa.array(model.score(batch.column(text), extractor) < 0.5))

    return docs.mapInArrow(run, docs.schema)
