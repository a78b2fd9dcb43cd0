"""Importance resampling towards a target: weights from hashed features, exact ranks.

A feature is a run of 1 to ``longest`` words, joined by one space; its bucket is the CRC-32
of its UTF-8 bytes modulo the number of buckets. The gain of a bucket is the log ratio of
its share in the target and in the corpus; both are counted over all texts, so the model is
one array of gains, and the weight of a document the floored mean over its features. Gumbel
noise from the id makes taking the highest scores a draw in proportion to the weights.

Ranks come from parallel sorting by regular sampling. Every stored partition is sorted by
itself; rows at regular distances in these runs give regular splitters. Rows of the ranges
that reach into the draw are exchanged by their range alone, put in order there, and counted
on from the sum of all ranges before. The driver sees a bounded sample and one count per
range. Full ties go by the row's place in the stored table, so no range outgrows its share.

A null text is empty and has no features, its weight is 0. A null doc_id is hashed as the
empty text and ranked before all others of its score. Of repeated rows each is ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.text import Words, per_document, ragged, running, slices, text_bytes, words_of
from lodestar.sources.staging import stage

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[97:123] = _BETWEEN[0x80:] = False


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value.astype(np.uint32)


_CRC = _crc_table()
# Ranges of more bytes are hashed one by one.
_LONG = 48


@dataclass(frozen=True)
class ResamplingSettings:
    longest: int = 1  # words in a feature
    buckets: int = 10_000
    seed: str = "2024"
    least_words: int = 20  # documents with fewer are never drawn
    percent: int = 10  # of the others, rounded down
    sample: int = 65_536  # rows that splitters are taken from, and one more per run at most
    range_rows: int = 1_000_000  # per sorted range, on average


def crc32_of_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of many ranges; those of equal length advance together, byte by byte."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1).astype(np.int16), kind="stable")
    at, length = start[order], size[order]
    value = np.full(len(order), 0xFFFFFFFF, np.uint32)
    active = np.searchsorted(-length, -np.arange(_LONG + 1), "left")
    for i in range(min(_LONG, int(length.max(initial=0)))):
        m = active[i]
        head = value[:m]
        value[:m] = _CRC[(head ^ data[at[:m] + i]) & np.uint32(255)] ^ (head >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~value
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def feature_words(column: pa.Array) -> Words:
    """Words of lower-cased texts; other bytes than digits, a-z and those above 127 part them."""
    data, offsets = text_bytes(column)
    return words_of(_LOWER[data], offsets, _BETWEEN)


def feature_buckets(words: Words, longest: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of a feature: the buckets of all features, and where each text's start."""
    start, end, data = words.start, words.end, words.data
    if longest > 1:
        # the words again, with one space after each
        size = end - start + 1
        edges = running(size)
        data = np.append(data, np.uint8(32))[np.minimum(ragged(start, size), len(data))]
        data[edges[1:] - 1] = 32
        start, end = edges[:-1], edges[1:] - 1
    found = []
    for k in range(1, longest + 1):
        first = words.windows(k)
        crc = crc32_of_ranges(data, start[first], end[first + k - 1])
        found.append(((crc % np.uint32(buckets)).astype(np.int64), np.searchsorted(words.doc[first], np.arange(words.n_docs + 1))))
    return found


def bucket_counts(texts: DataFrame, settings: ResamplingSettings, text: str = "text") -> np.ndarray:
    """Features per bucket over all texts; a task sends one row per bucket at most."""
    longest, buckets = settings.longest, settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, text):
            for which, _ in feature_buckets(feature_words(part.column(0)), longest, buckets):
                total += np.bincount(which, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, per bucket."""
    n = len(corpus)
    whole, wanted = float(corpus.sum() + n), float(target.sum() + n)
    ratio = [(t + 1.0) * whole / ((s + 1.0) * wanted) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, settings: ResamplingSettings) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight) of all documents."""
    longest, buckets = settings.longest, settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = feature_words(part.column(1))
            total = np.zeros(words.n_docs, np.int64)
            n = np.zeros(words.n_docs, np.int64)
            for which, bounds in feature_buckets(words, longest, buckets):
                total += per_document(gain[which], bounds)
                n += np.diff(bounds)
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts()), pa.array(n), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: str) -> Column:
    """Floored thousandths of Gumbel noise that the id and the seed fix."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


# Order of the draw: rows by these columns, ascending.
_KEY = ("down", "doc_id", "place")
_RANKED = "doc_id long, n_features long, weight long, score long"


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The order's columns of a batch; a null id comes first."""
    least = np.iinfo(np.int64).min
    return [batch.column(batch.schema.get_field_index(c)).fill_null(least).to_numpy(zero_copy_only=False) for c in _KEY]


def regular_splitters(rows: DataFrame, n: int, ranges: int, sample: int) -> list[np.ndarray]:
    """Splitters of n rows into ranges: one array for each column of the order."""
    distance = max(1, n // sample)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = distance // 2
        for batch in batches:
            if at < batch.num_rows:
                yield batch.take(pa.array(np.arange(at, batch.num_rows, distance)))
                at += -(-(batch.num_rows - at) // distance) * distance
            at -= batch.num_rows

    runs = rows.select(*_KEY).sortWithinPartitions(*_KEY)
    found = runs.mapInArrow(pick, "down long, doc_id long, place long").toArrow()  # bounded by the sample
    keys = [found.column(c).fill_null(np.iinfo(np.int64).min).to_numpy() for c in _KEY]
    order = np.lexsort(keys[::-1])
    at = np.unique(len(order) * np.arange(1, ranges) // ranges) if len(order) else np.zeros(0, np.int64)
    return [k[order][at] for k in keys]


def range_of(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """The range of every row: how many splitters come before it."""
    n = len(splitters[0])
    order = np.lexsort([np.concatenate([s, k]) for s, k in zip(splitters, keys, strict=True)][::-1])
    is_row = order >= n
    out = np.empty(len(keys[0]), np.int64)
    out[order[is_row] - n] = np.cumsum(~is_row)[is_row]
    return out


def ranked(rows: DataFrame, percent: int, settings: ResamplingSettings) -> DataFrame:
    """Stored rows with ``rank`` from 1 for the drawn share of those that ``may`` be drawn, else null."""
    spark: SparkSession = rows.sparkSession
    may = rows.filter("may")
    n = may.count()
    wanted = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    out = [f.split()[0] for f in _RANKED.split(", ")]
    if not wanted:
        return rows.select(*out, none)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // settings.range_rows))
    splitters = regular_splitters(may, n, ranges, max(settings.sample, ranges))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which = range_of(_columns(batch), splitters)
                yield batch.append_column("range", pa.array(which.astype(np.int32)))

    names = [*out, "down", "place", "may"]
    dealt = rows.select(*names).mapInArrow(place, f"{_RANKED}, down long, place long, may boolean, range int")
    sizes = np.zeros(ranges, np.int64)
    for row in dealt.filter("may").groupBy("range").count().collect():  # one row a range
        sizes[row["range"]] = row["count"]
    before = running(sizes)[:-1]
    reach = int(np.searchsorted(before, wanted, "left"))  # ranges that begin within the draw

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column(batch.schema.get_field_index("range")).to_numpy()
            opens = np.diff(which, prepend=current) != 0
            first = np.flatnonzero(opens)
            # rows before the first new range, maybe all, go on from the batch before
            start = np.append(at, before[which[first]] - first)
            rank = start[np.cumsum(opens)] + np.arange(1, batch.num_rows + 1)
            current, at = int(which[-1]), int(rank[-1])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rank, mask=rank > wanted)], names=[*out, "rank"])

    in_reach = F.col("may") & (F.col("range") < reach)
    drawn = (
        dealt.filter(in_reach).drop("may").repartitionById(reach, F.col("range"))
        .sortWithinPartitions("range", *_KEY).mapInArrow(number, f"{_RANKED}, rank long")
    )
    return drawn.unionByName(dealt.filter(~in_reach).select(*out, none))


def resample(docs: DataFrame, target: DataFrame, settings: ResamplingSettings = ResamplingSettings()) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank if it is drawn."""
    gain = gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    scored = weigh(docs, gain, settings).select(
        "*", (F.col("weight") + noise("doc_id", settings.seed)).alias("score"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = stage(scored.select("*", (-F.col("score")).alias("down"), (F.col("n_words") >= settings.least_words).alias("may")))
    return ranked(rows, settings.percent, settings)
