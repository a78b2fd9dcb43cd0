"""How filters of documents interact: what each one removes in every order.

The texts of a slice run through a byte transducer of two states, between words and in a
word. Its tables give the next state and the events of every (state, byte class): a word
starts or ends, a capital, a code point, a symbol. The next state depends on the byte alone,
so the states of all bytes are known at once and a table look-up per byte is the whole pass.
The word spans go into a hash table with open addressing, in rounds: each span claims its
slot or is compared byte by byte with the owner, and goes on to the next slot when they
differ, so the count of distinct words never rests on a hash.

Copies are found by the SHA-256 of the text, so one row per text and id is shuffled. A copy
in the least doc_id passes; all others fail, also those in rows removed before. A row without
doc_id is never a copy, and no copy of others. A null text is empty; repeated rows count
each. Labels of a doc_id that has several count if one of them says so.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.text import EXACT, mix, per_document, slices, span_checks, text_bytes
from lodestar.sources.staging import stage

# Byte classes; a byte above 127 that starts a character is OTHER.
BLANK, CAPITAL, TAIL, SYMBOL, OTHER = range(5)
BETWEEN, INSIDE = range(2)
WORD_START, WORD_END, IS_CAPITAL, CODE_POINT, IS_SYMBOL = 1, 2, 4, 8, 16

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[65:91] = CAPITAL
_CLASS[0x80:0xC0] = TAIL
_CLASS[list(b"#$%&*|")] = SYMBOL
# By class: the next state, the same from either state.
_NEXT = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
# By class: the events of any state, then those of a blank in a word and of a letter between words.
_EVENTS = np.array([CODE_POINT, CODE_POINT | IS_CAPITAL, 0, CODE_POINT | IS_SYMBOL, CODE_POINT], np.uint8)
_EMIT = np.stack([_EVENTS | np.where(_NEXT == INSIDE, WORD_START, 0), _EVENTS | np.where(_NEXT == BETWEEN, WORD_END, 0)])
_EMIT = _EMIT.astype(np.uint8)

MEASURES = "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, digest binary"


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The events at every byte, and the start and end of every word."""
    kind = _CLASS[data]
    state = np.zeros(len(data), np.uint8)
    state[1:] = _NEXT[kind[:-1]]
    state[offsets[:-1][offsets[:-1] < len(data)]] = BETWEEN
    events = _EMIT[state, kind]
    start = np.flatnonzero(events & WORD_START)
    open_at = offsets[1:][(offsets[1:] > offsets[:-1])]
    open_at = open_at[kind[open_at - 1] != BLANK]
    end = np.sort(np.concatenate([np.flatnonzero(events & WORD_END), open_at]), kind="stable")
    return events, start, end


class _Spans:
    """Byte ranges that can be compared with each other."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self._raw = data.tobytes()
        self._start, self._end, self._long = start, end, end - start > EXACT
        self._checks = span_checks(data, start, end)
        self.key = mix(self._checks[0] ^ mix(self._checks[1] + self._checks[2]))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of ranges a and b are equal, pair by pair."""
        equal = (self._checks[:, a] == self._checks[:, b]).all(0)
        for i in np.flatnonzero(equal & self._long[a]).tolist():
            x, y = a[i], b[i]
            equal[i] = self._raw[self._start[x] : self._end[x]] == self._raw[self._start[y] : self._end[y]]
        return equal


def first_in_document(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which spans own their slot of the table: one of each word of each document."""
    n = len(start)
    owns = np.zeros(n, bool)
    if not n:
        return owns
    spans = _Spans(data, start, end)
    mask = np.uint64((1 << (2 * n).bit_length()) - 1)
    slot = (mix(spans.key + mix(doc.astype(np.uint64))) & mask).astype(np.int64)
    table = np.full(int(mask) + 1, -1, np.int64)
    left = np.arange(n)
    while len(left):
        at = slot[left]
        free = table[at] < 0
        table[at[free]] = left[free]
        owner = table[at]
        mine = owner == left
        owns[left[mine]] = True
        met = mine | (doc[owner] == doc[left])
        met[~mine] &= spans.same(left[~mine], owner[~mine])
        left = left[~met]
        slot[left] = (slot[left] + 1) & int(mask)
    return owns


def measure(column: pa.Array) -> dict[str, np.ndarray | list]:
    """Words, distinct words, capitals, code points, symbols and digest of each text."""
    data, offsets = text_bytes(column)
    events, start, end = transduce(data, offsets)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    raw = memoryview(data.tobytes())
    return {
        "n_words": np.diff(first),
        "n_distinct": per_document(first_in_document(data, start, end, doc), first),
        "n_capitals": per_document(events & IS_CAPITAL != 0, offsets),
        "n_points": per_document(events & CODE_POINT != 0, offsets),
        "n_symbols": per_document(events & IS_SYMBOL != 0, offsets),
        "digest": [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
    }


def measured(docs: DataFrame, part: str = "source") -> DataFrame:
    """Rows (doc_id, part, measures) of all texts; a null part is the empty string."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            made = {k: pa.array(v, pa.binary()) if k == "digest" else pa.array(v) for k, v in measure(cut.column(2)).items()}
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), *made.values()], names=["doc_id", "part", *made])

    return rows.mapInArrow(run, f"doc_id long, part string, {MEASURES}")


def with_copies(rows: DataFrame) -> DataFrame:
    """Add ``copy``: whether a smaller doc_id has the same digest. ``rows`` should be a stored table."""
    least = (
        rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        .select("digest", "doc_id", F.lit(False).alias("later"))
    )
    return rows.join(least, ["digest", "doc_id"], "left").withColumn(
        "copy", F.col("doc_id").isNotNull() & F.coalesce(F.col("later"), F.lit(True))
    ).drop("later")


def _orders(letters: str) -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    steps = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, filter_at in enumerate(order, 1):
            steps.append({
                "filter_order": "".join(letters[i] for i in order), "step": step, "filter": filter_at, "before": before
            })
            before |= 1 << filter_at
    return steps


def _over_sets(k: int, cells: str, count: str) -> Column:
    """For every set of the k filters, how much of a count none of them removes."""
    return F.transform(
        F.sequence(F.lit(0), F.lit((1 << k) - 1)),
        lambda s: F.aggregate(
            cells, F.lit(0).cast("long"),
            lambda total, cell: total + F.when(cell["fails"].bitwiseAND(s) == 0, cell[count]).otherwise(0),
        ),
    )


def interactions(judged: DataFrame, fails: Sequence[tuple[str, Column]], good: Column, toxic: Column) -> DataFrame:
    """What every filter removes at every step of every order, for each ``part``.

    ``fails`` gives a letter and the condition of failure of each filter, six at most. The
    rows are counted by part, set of failed filters and labels first, so everything after it
    has at most 4 * 2^k rows a part.
    """
    letters = "".join(letter for letter, _ in fails)
    k = len(letters)
    if not 0 < k <= 6:
        raise ValueError("from one to six filters")
    bits = sum((F.when(fail, 1 << i).otherwise(0) for i, (_, fail) in enumerate(fails)), F.lit(0))
    cells = (
        judged.select("part", bits.alias("fails"), F.coalesce(good, F.lit(False)).alias("g"), F.coalesce(toxic, F.lit(False)).alias("x"))
        .groupBy("part", "fails")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("g").alias("good"), F.count_if("x").alias("toxic"))
        .groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    )
    sums = cells.select(
        "part", "cells", *[_over_sets(k, "cells", c).alias(f"kept_{c}") for c in ("n", "good", "toxic")]
    )
    ways = F.lit([math.factorial(s.bit_count()) * math.factorial(max(k - 1 - s.bit_count(), 0)) for s in range(1 << k)])

    def removed(kept: str, before: Column, bit: Column) -> Column:
        return F.col(kept)[before] - F.col(kept)[before.bitwiseOR(bit)]

    shapley = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.aggregate(
            F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.lit(0).cast("long"),
            lambda total, s: total + F.when(
                F.get(F.lit([1 << j for j in range(k)]), i).bitwiseAND(s) == 0,
                F.get(ways, s) * removed("kept_n", s, F.get(F.lit([1 << j for j in range(k)]), i)),
            ).otherwise(0),
        ),
    )
    steps = F.from_json(
        F.lit(json.dumps(_orders(letters))), "array<struct<filter_order: string, step: int, filter: int, before: int>>"
    )
    rows = sums.withColumn("shapleys", shapley).withColumn("s", F.explode(steps))
    before, at = F.col("s.before"), F.col("s.filter")
    bit = F.get(F.lit([1 << j for j in range(k)]), at)
    alone = F.aggregate(
        "cells", F.lit(0).cast("long"), lambda total, cell: total + F.when(cell["fails"] == bit, cell["n"]).otherwise(0)
    )
    here = removed("kept_n", before, bit)
    return rows.select(
        "part", "s.filter_order", "s.step",
        F.col("kept_n")[before.bitwiseOR(bit)].alias("kept"), here.alias("removed"),
        (removed("kept_n", F.lit(0), bit) - here).alias("redundant"), alone.alias("unique_fails"),
        removed("kept_good", before, bit).alias("good_lost"), removed("kept_toxic", before, bit).alias("toxic_lost"),
        F.col("shapleys")[at].alias("shapley"),
    )


def audit_filters(
    docs: DataFrame, labels: DataFrame, fails: Sequence[tuple[str, Column]], part: str = "source"
) -> DataFrame:
    """``interactions`` of filters over the measures, ``copy`` and labels of all documents.

    The conditions may use the measures by name and ``copy``. ``labels`` has doc_id, quality
    and toxic.
    """
    rows = stage(measured(docs, part))
    known = (
        labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    judged = with_copies(rows).join(known, "doc_id", "left")
    return interactions(judged, fails, F.col("quality") == 1, F.col("toxic") == 1)
