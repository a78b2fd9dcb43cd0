"""Quality rules over whole texts, with repetition found by a suffix array of words.

The suffix array of a slice of documents is built by prefix doubling on word ranks that
include the document, so a repeat never spans two documents. After each doubling only the
suffixes that still tie are sorted. The ranks of every level give the longest common
prefix of neighbours by binary descent. The longest repeat that starts at a word is the
larger of its two neighbour prefixes; the spans of all repeats of at least k words are the
union of the spans of the LCP intervals of depth k or more.

A null or empty text has no words, fails the base rules and is not kept. Repeated rows are
judged alike, each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.text import (
    IS_SPACE,
    Words,
    column_words,
    mix,
    passing,
    per_document,
    slices,
    span_hashes,
)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = 10


@dataclass(frozen=True)
class RepetitionLimits:
    """A text is rejected when its repeats of ``least_words`` or more cover more than
    ``most_covered`` of its words, or one repeat is longer than ``longest`` words."""

    least_words: int = 10
    most_covered: float = 0.3
    longest: int = 100


def longest_repeats(words: Words) -> np.ndarray:
    """For each word the length of the longest repeat that starts there.

    A repeat is a run of words that occurs at two places of the document, which may overlap.
    """
    n = len(words.doc)
    if not n:
        return np.zeros(0, np.int64)
    stop = words.first[1:][words.doc]
    keys = mix(words.hashes() + mix(words.doc.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    levels = [_ranks(keys[order], order, np.zeros(n, np.int64), np.arange(n))]
    suffixes, k = order, 1
    while True:
        rank = levels[-1]
        tied = np.flatnonzero(_ties(rank[suffixes]))
        if not len(tied):
            break
        active = suffixes[tied]
        behind = active + k
        second = np.where(behind < stop[active], rank[np.minimum(behind, n - 1)] + 1, 0)
        pair = rank[active] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        suffixes = suffixes.copy()
        suffixes[tied] = active[by]
        levels.append(_ranks(pair[by], active[by], rank.copy(), tied))
        k *= 2
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    near = np.flatnonzero(words.doc[left] == words.doc[right])
    for level in range(len(levels) - 1, -1, -1):
        a, b = left[near] + common[near], right[near] + common[near]
        fits = (a < stop[left[near]]) & (b < stop[right[near]])
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        common[near] += (fits & (levels[level][a] == levels[level][b])) * (1 << level)
    longest = np.zeros(n, np.int64)
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest


def _ties(ranks: np.ndarray) -> np.ndarray:
    same = np.zeros(len(ranks) + 1, bool)
    same[1:-1] = ranks[1:] == ranks[:-1]
    return same[1:] | same[:-1]


def _ranks(keys: np.ndarray, at: np.ndarray, rank: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Rank the sorted suffixes by the first slot of their group of equal keys."""
    opens = np.ones(len(keys), bool)
    opens[1:] = keys[1:] != keys[:-1]
    rank[at] = np.maximum.accumulate(np.where(opens, slots, 0))
    return rank


def covered(words: Words, longest: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeat of at least ``least`` words."""
    change = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:-1]) > 0


def _repeated_lines(words: Words) -> np.ndarray:
    """Per document the lines with a word that equal an earlier line."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == _NEWLINE)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    stop = np.append(start[1:], len(data))
    stop = stop - (data[stop - 1] == _NEWLINE)
    filled = per_document(~IS_SPACE[data], np.append(start, len(data))) > 0
    start, stop = start[filled], np.maximum(stop, start)[filled]
    doc = np.searchsorted(offsets, start, "right") - 1
    keys = span_hashes(data, start, stop)
    order = np.lexsort((keys, doc))
    same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=words.n_docs)


def measure(column: pa.Array, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """The measures of each text of a column, and whether it is kept."""
    words = column_words(column)
    n_words = words.counts()
    longest = longest_repeats(words)
    letters = ~IS_SPACE[words.data] & ((words.data & 0xC0) != 0x80)
    in_three = per_document(covered(words, longest, 3), words.first)
    in_repeats = per_document(covered(words, longest, limits.least_words), words.first)
    filled = np.flatnonzero(n_words)
    most = np.zeros(words.n_docs, np.int64)
    if len(filled):
        most[filled] = np.maximum.reduceat(longest, words.first[:-1][filled])
    failed = (n_words < 50) | (100 * in_three > 50 * n_words)
    over = (in_repeats > limits.most_covered * n_words) | (most > limits.longest)
    return {
        "n_words": n_words,
        "word_chars": per_document(letters, words.offsets),
        "n_symbols": per_document(SYMBOLS[words.data], words.offsets),
        "n_dup_lines": _repeated_lines(words),
        "n_repeat_words": in_three,
        "n_covered_words": in_repeats,
        "longest_repeat": most,
        "base_failed": failed,
        "kept": ~failed & ~over,
    }


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def score_quality(
    docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), text: str = "text"
) -> DataFrame:
    """Add the measures of each whole text as a struct ``quality``; all columns are kept."""
    kept = [c for c in docs.columns if c != "quality"]
    names = [f"c{i}" for i in range(len(kept))]
    source = names[kept.index(text)]
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, source):
            found = measure(part.column(names.index(source)), limits)
            yield passing(part, names, **{f"q_{k}": v for k, v in found.items()})

    fields = ", ".join(f"q_{f.strip()}" for f in MEASURES.split(","))
    schema = ", ".join(f"{n} {t}" for n, t in flat.dtypes) + ", " + fields
    measures = F.struct(*[F.col(f"q_{f.split()[0]}").alias(f.split()[0]) for f in MEASURES.split(",")])
    return flat.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], measures.alias("quality")
    )
