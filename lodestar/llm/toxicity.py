"""Toxicity by gradient-boosted trees over dense features of the whole text.

The features are densities of a lexicon (stated words, and words and stems learned from
labelled rows), how near its words stand to the second person, and rates of capitals,
punctuation and disguised spelling. The lexicon is learned from one part of the training
rows and the trees from the other, both bounded samples chosen by a hash of ``doc_id``; the
probability is calibrated by isotonic regression on predictions for held-back folds. Every
document is scored by its text alone. A null text scores as an empty one, repeated rows
alike; without labels of both kinds the score is the share of toxic labels, 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.boosting import BoostedTrees, isotonic
from lodestar.llm.text import (
    Words,
    column_words,
    per_document,
    span_hashes,
    running,
    slices,
)
from lodestar.sources.staging import stage

# Insults to start from, and words that address somebody.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting",
    "clown", "dumb", "fool", "jerk", "imbecile", "hate", "filth", "vermin", "garbage", "coward", "liar",
    "dummkopf", "abschaum", "idioten", "verlierer", "connard", "imbécile", "crétin", "ordure",
    "estúpido", "imbécil", "basura", "asqueroso",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "youre", "tu", "toi", "ton", "ta", "vous", "votre",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "te", "ti", "usted", "ustedes", "vosotros",
)

STEMS = (4, 5, 6, 7)
NEAR = 5

_PLAIN = np.zeros(256, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[0x80:] = np.arange(0x80, 256)
_UNMASKED = _PLAIN.copy()
for _sign, _letter in zip(b"013457@$!", b"oieastasi", strict=True):
    _UNMASKED[_sign] = _letter
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&@^~_=+<>|/\\")] = True

FEATURES = (
    "insults", "insult_density", "learned_words", "learned_stems", "learned_weight", "learned_density",
    "largest_weight", "near_second_person", "second_person", "disguised", "mixed_spelling", "capitals",
    "capital_words", "exclamations", "questions", "signs", "log_words",
)


@dataclass(frozen=True)
class Lexicon:
    """Hashes of words or stems in rising order, with the log-odds of each."""

    keys: np.ndarray
    weights: np.ndarray

    def weight(self, keys: np.ndarray) -> np.ndarray:
        """The weight of each hash, 0 for others."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.weights[at], 0.0)


@dataclass(frozen=True)
class _Form:
    """The letters of words after a mapping of bytes: hashes of words and of stems."""

    values: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, words: Words, mapping: np.ndarray) -> _Form:
        letters = mapping[words.data]
        tail = np.zeros(len(letters), bool)
        tail[1:] = (words.data[:-1] == 0xC3) & (words.data[1:] >= 0x80) & (words.data[1:] < 0x9F) & (words.data[1:] != 0x97)
        letters = letters + (tail.view(np.uint8) << 5)
        keep = letters > 0
        at = running(keep.astype(np.int64))
        return cls(letters[keep], at[words.start], at[words.end])

    def words(self) -> np.ndarray:
        return span_hashes(self.values, self.start, self.end)

    def stems(self, length: int) -> np.ndarray:
        """Hashes of the first bytes of the words, 0 for shorter words."""
        end = np.minimum(self.start + length, self.end)
        found = span_hashes(self.values, self.start, end) ^ np.uint64(length)
        return np.where(self.end - self.start >= length, found, np.uint64(0))


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    column = column_words(pa.array([" ".join(words)]))
    return np.sort(_Form.of(column, _PLAIN).words())


_INSULT_KEYS = _hashes(INSULTS)
_PERSON_KEYS = _hashes(SECOND_PERSON)


def features(words: Words, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per document."""
    plain, unmasked = _Form.of(words, _PLAIN), _Form.of(words, _UNMASKED)
    keys, bare = plain.words(), unmasked.words()
    insult, hidden = np.isin(keys, _INSULT_KEYS), np.isin(bare, _INSULT_KEYS)
    person = np.isin(keys, _PERSON_KEYS)
    word_weight = lexicon.weight(keys)
    stem_weight = np.zeros(len(keys))
    for length in STEMS:
        stem_weight = np.maximum(stem_weight, lexicon.weight(plain.stems(length)))
    hidden |= lexicon.weight(bare) > 0
    weight = np.maximum(word_weight, stem_weight)
    hit = insult | (weight > 0)
    to = running(person.astype(np.int64))
    at = np.arange(len(keys))
    low, high = np.maximum(at - NEAR, words.first[:-1][words.doc]), np.minimum(at + NEAR + 1, words.first[1:][words.doc])
    near = hit & (to[high] > to[low])
    n = np.maximum(words.counts(), 1)
    n_letters = np.maximum(per_document(_ASCII_LETTER[words.data], words.offsets), 1)
    n_bytes = np.maximum(np.diff(words.offsets), 1)
    inside = running(_DIGIT[words.data] | _SIGNS[words.data])
    letters = plain.end - plain.start
    upper = running(_UPPER[words.data].astype(np.int64))
    capital = (upper[words.end] - upper[words.start] >= 2) & (upper[words.end] - upper[words.start] >= letters)
    mixed = (letters > 0) & (inside[words.end] != inside[words.start]) if len(keys) else np.zeros(0, bool)

    def total(flags: np.ndarray) -> np.ndarray:
        return per_document(flags, words.first)

    sums = np.diff(np.concatenate([[0.0], np.cumsum(weight)])[words.first])
    largest = np.zeros(words.n_docs)
    filled = np.flatnonzero(words.counts())
    if len(filled):
        largest[filled] = np.maximum.reduceat(weight, words.first[:-1][filled])
    columns = [
        total(insult), total(insult) / n, total(word_weight > 0), total(stem_weight > 0), sums, total(hit) / n,
        largest, total(near), total(person) / n, total(hidden & ~hit), total(mixed) / n,
        per_document(_UPPER[words.data], words.offsets) / n_letters, total(capital) / n,
        per_document(words.data == 33, words.offsets) / n_bytes, per_document(words.data == 63, words.offsets) / n_bytes,
        per_document(_SIGNS[words.data], words.offsets) / n_bytes, np.log1p(words.counts()),
    ]
    return np.stack([np.asarray(c, float) for c in columns], 1)


@dataclass(frozen=True)
class ToxicitySettings:
    """``lexicon_rows`` and ``tree_rows`` bound the labelled rows that the lexicon and the
    trees are fitted on, on average; entries need a log-likelihood ratio of ``least_ratio``."""

    lexicon_rows: int = 8_000
    tree_rows: int = 20_000
    most_entries: int = 5_000
    least_ratio: float = 11.0
    folds: int = 5


@dataclass(frozen=True)
class ToxicityModel:
    """Scores texts."""

    lexicon: Lexicon
    trees: BoostedTrees | None
    points: np.ndarray
    values: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.values[0])
        margins = self.trees.margins(features(column_words(column), self.lexicon))
        return np.clip(np.interp(margins, self.points, self.values), 0.0, 1.0)


def _sampled(labelled: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id."""
    n = labelled.count()
    share = min(1.0, most / max(n, 1))
    return labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def _learn_lexicon(rows: DataFrame, settings: ToxicitySettings) -> Lexicon:
    """Words and stems whose documents are toxic far more often than others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = column_words(part.column(0))
            plain = _Form.of(words, _PLAIN)
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            forms = [plain.words(), *[plain.stems(n) for n in STEMS]]
            for keys in forms:
                used = keys != 0
                both = np.unique(np.stack([words.doc[used].astype(np.uint64), keys[used]], 1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 1].view(np.int64) if len(both) else np.zeros(0, np.int64)), pa.array(toxic[both[:, 0].astype(np.int64)])],
                    names=["key", "toxic"],
                )

    counts = rows.groupBy().agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = counts["bad"] or 0, counts["n"] - (counts["bad"] or 0)
    if not bad or not good:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    found = rows.select("text", "toxic").mapInArrow(run, "key long, toxic long").groupBy("key").agg(
        F.sum("toxic").cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("df")
    )
    share = bad / (bad + good)
    y = F.col("df") - F.col("x")
    ratio = 2 * (
        F.when(F.col("x") > 0, F.col("x") * F.log(F.col("x") / (F.col("df") * share))).otherwise(0.0)
        + F.when(y > 0, y * F.log(y / (F.col("df") * (1 - share)))).otherwise(0.0)
    )
    odds = F.log((F.col("x") + 0.5) / (bad + 1.0)) - F.log((y + 0.5) / (good + 1.0))
    best = (
        found.select("key", ratio.alias("ratio"), odds.alias("odds"))
        .filter((F.col("ratio") >= settings.least_ratio) & (F.col("odds") > 1.0))
        .orderBy(F.desc("ratio"), "key").limit(settings.most_entries).collect()
    )
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], np.array([r["odds"] for r in best], float)[order])


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """Fit on labelled documents: ``labels`` has doc_id and toxic, one label per document.

    Of several labels of a document the largest counts; null labels are dropped.
    """
    known = (
        labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
        .withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)))
    )
    for_lexicon = _sampled(known.filter("half = 0"), settings.lexicon_rows)
    for_trees = _sampled(known.filter("half = 1"), settings.tree_rows)
    # both samples are bounded by the settings, so the broadcast is
    chosen = F.broadcast(for_lexicon.unionByName(for_trees))
    rows = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
        .groupBy("doc_id", *[c for c in chosen.columns if c != "doc_id"]).agg(F.min("text").alias("text"))
    )
    lexicon = _learn_lexicon(rows.filter("half = 0"), settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = features(column_words(part.column(0)), lexicon)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), *[pa.array(c) for c in found.T]], names=["doc_id", "toxic", *FEATURES]
            )

    schema = "doc_id long, toxic long, " + ", ".join(f"{f} double" for f in FEATURES)
    table = rows.filter("half = 1").select("text", "doc_id", "toxic").mapInArrow(run, schema).toPandas()
    table = table.sort_values("doc_id", kind="stable")
    x, y = table[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), table["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicon, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    fold = np.zeros(len(y), np.int64)
    for label in (0.0, 1.0):
        at = np.flatnonzero(y == label)
        fold[at] = np.arange(len(at)) % settings.folds
    margins = np.zeros(len(y))
    for k in range(settings.folds):
        held = fold == k
        if held.any():
            part = y[~held]
            if len(part) and part.min() < part.max():
                margins[held] = BoostedTrees().fit(x[~held], part).margins(x[held])
    points, values = isotonic(margins, y)
    return ToxicityModel(lexicon, BoostedTrees().fit(x, y), points, values)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id`` and the ``score`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
