"""Near duplicates by BagMinHash signatures of word shingles, banded and verified.

A document is the bag of its runs of five words (one of fewer words is one run, one without
words has none and is like no other). Every run with its weight, the number of times it
occurs, throws points of a Poisson process: the weights are discretised to whole numbers, the
unit (0, 1] and the dyadic ranges (1, 2], (2, 4], ... each have a process of their own whose
rate is the width of the range, and a point in a range counts if its place is at most the
weight. So the points of a lesser weight are among those of a greater one. Points come in
order of time and each belongs to a random register, which keeps the first: two documents
agree in a register with the probability of their weighted Jaccard similarity. A process
stops once it is later than all registers.

Documents with the same words are one class from the start. Registers are joined to bands.
In every bucket of a band each text is verified, by exact overlap of the bags, against a
pivot, the text that shares most buckets with others, and linked texts are joined to
components. So a large group of near copies costs a row per text. Texts that miss a pivot may
still have links to others that share it: with X+ and X- the weight that X has beyond the
pivot P and lacks of it, and c the weight that X and Y both have beyond it, their distance
|X| + |Y| - 2 overlap is at least X+ + Y+ - 2c + |X- - Y-|, and a link needs it to be at most
a ninth of |X| + |Y|. A bit mask of what each text has beyond the pivot bounds c from above,
so only pairs whose masks agree enough are verified, and no link among texts that share a
pivot is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import connected_components
from lodestar.llm.text import Words, column_words, mix, range_hashes, running, seeds, slices, text_bytes, words_of
from lodestar.sources.staging import stage

SHINGLE = 5
BANDS = 32
ROWS = 5
# Similarity of a link, as a ratio of whole numbers.
LINK = (4, 5)
# Words of 64 bits in the mask of what a text has beyond its pivot.
MASK = 16

_SALT = seeds(8, 2)
_UNIT = 2.0**-53


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word runs of all documents, and the document of each."""
    values = mix(words.hashes())
    counts = words.counts()
    start = words.windows(size)
    hashes, doc = range_hashes(values, start, start + size), words.doc[start]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hashes = np.concatenate([hashes, range_hashes(values, words.first[short], words.first[short + 1])])
        doc = np.concatenate([doc, short])
    return hashes, doc


def bags(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different runs of each document with their weights, in order of document and hash."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(opens)
    return hashes[first], doc[first], np.diff(np.append(first, len(doc)))


def _processes(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The element of each process and its level: 0 for (0, 1], j for (2^(j-1), 2^j]."""
    levels = np.ceil(np.log2(weights)).astype(np.int64)
    count = levels + 1
    element = np.repeat(np.arange(len(weights)), count)
    return element, np.arange(len(element)) - np.repeat(running(count)[:-1], count)


def signatures(hashes: np.ndarray, doc: np.ndarray, weights: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The point that came first in each register, a row per document."""
    times = np.full((n_docs, m), np.inf)
    found = np.zeros((n_docs, m), np.uint64)
    if not len(hashes):
        return found
    element, level = _processes(weights)
    seed = mix(hashes[element] ^ (level.astype(np.uint64) * _SALT[0]))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    weight, owner = weights[element], doc[element]
    now, thrown = np.zeros(len(seed)), 0
    latest = np.full(n_docs, np.inf)
    while len(seed):
        block = int(np.clip(20_000 // len(seed), 1, 64))
        step = np.arange(thrown + 1, thrown + block + 1, dtype=np.uint64)
        point = mix(seed[:, None] + step * _SALT[1])
        gap = -np.log(((point >> np.uint64(11)).astype(float) + 0.5) * _UNIT)
        when = now[:, None] + np.cumsum(gap, 1) / width[:, None]
        early = when <= latest[owner][:, None]
        if width.max() > 1:
            place = low[:, None] + 1 + (mix(point ^ _SALT[2]) % width[:, None].astype(np.uint64)).astype(np.int64)
            place[low == 0] = 1
            early_counts = early & (place <= weight[:, None])
        else:
            early_counts = early
        at, nth = np.nonzero(early_counts)
        hit, time = point[at, nth], when[at, nth]
        register = owner[at] * m + (mix(hit ^ _SALT[3]) % np.uint64(m)).astype(np.int64)
        flat, ids = times.reshape(-1), found.reshape(-1)
        np.minimum.at(flat, register, time)
        first = flat[register] == time
        ids[register[first]] = hit[first]
        rows = np.unique(owner)
        latest[rows] = times[rows].max(1)
        now, thrown = when[:, -1], thrown + block
        on = now <= latest[owner]
        seed, low, width, weight, owner, now = (x[on] for x in (seed, low, width, weight, owner, now))
    return found


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SALT[4], parts.shape[:2])
    for r in range(rows):
        key = mix(key * _SALT[5] ^ parts[:, :, r])
    return key


SKETCH = "doc_id long, t long, k1 long, k2 long, size int, bands array<long>"


def _sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Per document: keys of its words, number of runs, and band keys (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = column_words(part.column(2))
            # two keys of the words in order that have nothing in common
            keys = [
                range_hashes(words.hashes(seed), words.first[:-1], words.first[1:]).view(np.int64) for seed in (1, 2)
            ]
            runs, doc = shingles(words)
            size = np.bincount(doc, minlength=words.n_docs)
            bag = bags(runs, doc)
            found = band_keys(signatures(*bag, words.n_docs, bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(words.n_docs + 1, dtype=np.int32) * bands),
                pa.array(found.view(np.int64).reshape(-1)), mask=pa.array(size == 0),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(keys[0]), pa.array(keys[1]), pa.array(size.astype(np.int32)), lists],
                names=[f.split()[0] for f in SKETCH.split(", ")],
            )

    return docs.select("doc_id", "t", "text").mapInArrow(run, SKETCH)


def compared(left: pa.Array, right: pa.Array) -> dict[str, np.ndarray]:
    """Weights of the bags of pairs of texts, their overlap, and a mask of what only the
    right text has or has more of."""
    a, b = text_bytes(left), text_bytes(right)
    n = len(left)
    words = words_of(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1][1:] + a[1][-1]]))
    runs, doc = shingles(words)
    hashes, owner, weight = bags(runs, doc)
    total = np.bincount(owner, weight, 2 * n).astype(np.int64)
    pair = owner % n
    order = np.lexsort((owner, hashes, pair))
    hashes, owner, pair, weight = hashes[order], owner[order], pair[order], weight[order]
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (pair[1:] == pair[:-1]))
    overlap = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), n).astype(np.int64)
    beyond = np.where(owner >= n, weight, 0)
    beyond[same + 1] -= weight[same]
    more = np.flatnonzero(beyond > 0)
    bits = np.zeros((n, 64 * MASK), np.uint8)
    bits[pair[more], (mix(hashes[more] ^ _SALT[3]) % np.uint64(64 * MASK)).astype(np.int64)] = 1
    masks = np.packbits(bits, axis=1).view(np.int64)
    return {
        "size_a": total[:n], "size_b": total[n:], "overlap": overlap,
        "link": overlap * (LINK[0] + LINK[1]) >= (total[:n] + total[n:]) * LINK[0],
        "bits": bits.sum(1, dtype=np.int64),
        "mask": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * MASK, masks.reshape(-1)),
    }


VERIFIED = "a long, b long, size_a long, size_b long, overlap long, link boolean, bits long, mask array<long>"


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of nodes a, b with the comparison of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ta", 1 << 19):
            found = compared(part.column(2), part.column(3))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[v if isinstance(v, pa.Array) else pa.array(v) for v in found.values()]], names=["a", "b", *found]
            )

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    return stage(joined.mapInArrow(run, VERIFIED))


def _may_link(first: DataFrame, grouped: DataFrame) -> DataFrame:
    """Pairs of texts in different components that share a pivot and may be linked."""
    placed = (
        first.join(grouped.select(F.col("node").alias("b"), "root"), "b", "left")
        .select(
            F.col("a").alias("pivot"), F.col("b").alias("node"), F.coalesce("root", "b").alias("root"), "link",
            F.col("size_b").alias("size"), (F.col("size_b") - F.col("overlap")).alias("plus"),
            (F.col("size_a") - F.col("overlap")).alias("minus"), "bits", "mask",
        )
    )
    placed = stage(placed)
    missed = placed.filter(~F.col("link"))
    open_ = stage(missed.select("pivot").distinct())
    x = missed.select("pivot", *[F.col(c).alias(f"{c}_x") for c in placed.columns if c not in ("pivot", "link")])
    y = placed.join(open_, "pivot").select(
        "pivot", *[F.col(c).alias(f"{c}_y") for c in placed.columns if c not in ("pivot", "link")]
    )
    both = F.col("size_x") + F.col("size_y")
    far = F.col("plus_x") + F.col("plus_y") + F.abs(F.col("minus_x") - F.col("minus_y"))
    # twice the weight that both must have beyond the pivot, times the scale of the ratio
    scale = LINK[0] + LINK[1]
    needed = F.ceil((far * scale - both * (LINK[1] - LINK[0])) / (2.0 * scale))
    each = F.zip_with("mask_x", "mask_y", lambda a, b: F.bit_count(a.bitwiseAND(b)))
    common = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    least = needed + F.greatest(F.col("bits_x") - F.col("plus_x"), F.col("bits_y") - F.col("plus_y"))
    return (
        x.join(y, "pivot")
        .filter(
            (F.col("node_x") != F.col("node_y")) & (F.col("root_x") != F.col("root_y"))
            & (F.col("size_x") * LINK[1] >= F.col("size_y") * LINK[0])
            & (F.col("size_y") * LINK[1] >= F.col("size_x") * LINK[0])
            & ((needed <= 0) | (common >= F.greatest(F.lit(1), least)))
        )
        .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    )


def near_duplicate_classes(
    docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: ``doc_id``, ``t`` (a hash of its text) and ``class_id``.

    ``class_id`` is the least ``doc_id`` of the documents that links connect, the document's
    own when it has no words. A null ``doc_id`` takes the class of its text. Repeated rows
    fall in one class.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
        F.xxhash64(F.col(f"`{text}`")).alias("t"),
    )
    sketches = stage(_sketches(source, bands, rows))
    worded = sketches.filter("bands is not null")
    # one node per different sequence of words
    nodes = stage(
        worded.filter("doc_id is not null").groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "t", "size", "bands")).alias("r"))
        .select("k1", "k2", "r.*")
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    # sums are staged before they are joined back, so that Spark can split a hot bucket
    buckets = stage(banded.groupBy("band").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    members = stage(banded.join(buckets, "band"))
    shared = members.groupBy("node").agg(F.sum("many").alias("shared"))
    pivots = stage(
        members.join(shared, "node").groupBy("band")
        .agg(F.max(F.struct("shared", (-F.col("node")).alias("node"))).alias("best"))
        .select("band", (-F.col("best.node")).alias("pivot"))
    )
    candidates = members.select("node").distinct().join(nodes.select("node", "doc_id", "t"), "node")
    texts = stage(
        source.join(candidates, ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"])
    )
    to_pivot = (
        members.join(pivots, "band").filter("node <> pivot")
        .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    )
    first = _verified(to_pivot, texts)
    linked = first.filter("link").select("a", "b")
    grouped = connected_components(linked)
    second = _verified(_may_link(first, grouped), texts)
    bridges = second.filter("link").select("a", "b")
    if not bridges.isEmpty():
        grouped = connected_components(linked.unionByName(bridges))

    rooted = nodes.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = rooted.join(least, "root").select("k1", "k2", "class_id")
    return (
        sketches.join(classes, ["k1", "k2"], "left")
        .select(
            "doc_id", "t",
            F.when(F.col("bands").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        )
    )
