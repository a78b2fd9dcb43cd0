"""Removal of word runs that occur in an earlier document.

Every run of ``length`` words has a Rabin-Karp hash. A window is only sent to be counted
when it can repeat at all: the least hash of the shorter runs inside it is its anchor, equal
windows have equal anchors at equal places, so windows whose anchor is in one document only
are unique. Successive windows with one anchor form a segment. Equal segments are settled
together by the least document that has them. Where an anchor has different segments, the
windows of the first document of each segment are counted one by one. Both counts are plain
Spark aggregates, summed before the shuffle, so a passage that very many documents share
costs a row per task. Keys are pairs of independent 64-bit hashes.

A word is covered when a window over it also starts in a document with a smaller
``doc_id``; windows are judged on the input. Rows of one ``doc_id`` do not cover each other,
a row without ``doc_id`` neither loses words nor takes any. Null and empty texts have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.text import Words, column_words, mix, ragged, range_hashes, running, slices
from lodestar.sources.staging import stage

LENGTH = 50
# An anchor is one of 2^5 shorter runs of a window.
_HALVINGS = 5

SEGMENTS = "anchor long, segment long, doc_id long, t long, at int, n int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes of the shorter runs, the windows, and the anchor of each."""
    values = mix(words.hashes())
    n, inner = len(values), length - (1 << _HALVINGS) + 1
    at = np.arange(max(0, n - inner + 1))
    runs = range_hashes(values, at, at + inner)
    place = np.uint64((1 << max(1, n.bit_length())) - 1)
    least = (runs & ~place) | at.astype(np.uint64)
    for step in range(_HALVINGS):
        least = np.minimum(least[: -(1 << step)], least[1 << step :])
    start = words.windows(length)
    return values, runs, start, (least[start] & place).astype(np.int64)


def segments(words: Words, length: int) -> dict[str, np.ndarray]:
    """Runs of successive windows with the same anchor."""
    empty = np.zeros(0, np.int64)
    if len(words.doc) < length:
        return dict.fromkeys(("anchor", "segment", "doc", "at", "n"), empty)
    values, runs, start, anchor = _anchors(words, length)
    if not len(start):
        return dict.fromkeys(("anchor", "segment", "doc", "at", "n"), empty)
    opens = np.ones(len(start), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(opens)
    n = np.diff(np.append(first, len(start)))
    at, mine = start[first], anchor[first]
    form = mix(((mine - at) * (1 << 32) + n).astype(np.uint64))
    whole = range_hashes(values, at, at + n + length - 1)
    doc = words.doc[at]
    return {
        "anchor": runs[mine].view(np.int64), "segment": mix(whole ^ form).view(np.int64),
        "doc": doc, "at": at - words.first[doc], "n": n,
    }


def _kept(raw: bytes, removed: np.ndarray | None) -> tuple[bytes, int, int]:
    """The words that stay joined by one space, and how many there were and went."""
    words = raw.split()
    n = len(words)
    if removed is None or not removed.any():
        return b" ".join(words), n, 0
    stay = np.flatnonzero(~removed).tolist()
    return b" ".join([words[i] for i in stay]), n, n - len(stay)


def _cover(n: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n words lie in some range."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def _pairs(column: pa.Array, row: int, *fields: str) -> tuple[np.ndarray, ...]:
    """The fields of a list of structs in one row; empty for a null list."""
    scalar = column[row]
    if not scalar.is_valid:
        return tuple(np.zeros(0, np.int64) for _ in fields)
    return tuple(scalar.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document: words, removed words and the digest of what stays.

    ``with_text`` adds the text that stays, words joined by one space.
    """
    if length <= 1 << _HALVINGS:
        raise ValueError(f"length must be more than {1 << _HALVINGS}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = segments(column_words(part.column(1)), length)
            doc = pa.array(found["doc"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["anchor"]), pa.array(found["segment"]), part.column(0).take(doc),
                    part.column(2).take(doc), pa.array(found["at"].astype(np.int32)), pa.array(found["n"].astype(np.int32)),
                ],
                names=[f.split()[0] for f in SEGMENTS.split(", ")],
            )

    every = stage(rows.filter("doc_id is not null").mapInArrow(find, SEGMENTS))
    # sums are staged before they are joined back, so that both sides of each join are plain
    # shuffles and Spark can split the rows of a very common anchor
    common = every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    shared = stage(every.join(stage(common.select("anchor")), "anchor").dropDuplicates(["doc_id", "t", "at"]))
    least = stage(shared.groupBy("anchor", "segment").agg(F.min("doc_id").alias("least")))
    forms = stage(least.groupBy("anchor").agg(F.count(F.lit(1)).alias("forms")))
    sums = stage(least.join(forms, "anchor"))
    settled = F.col("doc_id") > F.col("least")
    place = F.struct("at", "n")
    known = (
        shared.join(sums, ["anchor", "segment"])
        .filter(settled | (F.col("forms") > 1))
        .groupBy("doc_id", "t")
        .agg(
            F.collect_list(F.when(settled, place)).alias("gone"),
            F.collect_list(F.when(~settled, place)).alias("open"),
        )
    )

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish documents whose words are settled; list the windows to count of others."""
        for part in slices(batches, "text"):
            words = column_words(part.column(1))
            open_ = part.column(4)
            busy = [i for i in range(part.num_rows) if open_[i].is_valid and len(open_[i].values)]
            windows: list[dict | None] = [None] * part.num_rows
            gone: list[tuple | None] = [None] * part.num_rows
            if busy:
                values, runs, start, anchor = _anchors(words, length)
                hashes = range_hashes(values, start, start + length).view(np.int64)
                names = runs.view(np.int64)
            for i in busy:
                at, n = _pairs(open_, i, "at", "n")
                place = ragged(at + words.first[i], n)
                slot = np.searchsorted(start, place)
                windows[i] = {"place": place - words.first[i], "anchor": names[anchor[slot]], "window": hashes[slot]}
            sha, text, counts, removed = [], [], [], []
            raw = words.data.tobytes()
            bounds = words.offsets.tolist()
            sizes = words.counts().tolist()
            for i in range(part.num_rows):
                at, n = _pairs(part.column(3), i, "at", "n")
                if windows[i] is not None:
                    gone[i] = (at, n)
                    sha.append(None)
                    text.append(raw[bounds[i] : bounds[i + 1]].decode())
                    counts.append(sizes[i])
                    removed.append(0)
                    continue
                cover = _cover(sizes[i], at, n + length - 1) if len(at) else None
                kept, total, lost = _kept(raw[bounds[i] : bounds[i + 1]], cover)
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode() if with_text else None)
                counts.append(total)
                removed.append(lost)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(sha, pa.string()), pa.array(text, pa.string()),
                    _structs(gone, ("at", "n")), _structs(windows, ("place", "anchor", "window")),
                ],
                names=["doc_id", "t", "n_words", "n_removed", "kept_sha256", "text", "gone", "windows"],
            )

    passed = stage(
        rows.join(known, ["doc_id", "t"], "left").select("doc_id", "text", "t", "gone", "open")
        .mapInArrow(
            first_pass,
            "doc_id long, t long, n_words long, n_removed long, kept_sha256 string, text string, "
            "gone array<struct<at:long,n:long>>, windows array<struct<place:long,anchor:long,window:long>>",
        )
    )
    done = passed.filter("windows is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "text")
    waiting = passed.filter("windows is not null")
    counted = waiting.select("doc_id", "t", F.inline("windows")).distinct()
    earliest = stage(counted.groupBy("anchor", "window").agg(F.min("doc_id").alias("least")))
    repeated = (
        counted.join(earliest, ["anchor", "window"]).filter("doc_id > least")
        .groupBy("doc_id", "t").agg(F.collect_list("place").alias("places"))
    )

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, text, removed = [], [], []
            for i in range(batch.num_rows):
                at, n = _pairs(batch.column(3), i, "at", "n")
                places = batch.column(4)[i]
                extra = places.values.to_numpy(zero_copy_only=False) if places.is_valid else np.zeros(0, np.int64)
                starts = np.concatenate([at, extra]).astype(np.int64)
                sizes = np.concatenate([n + length - 1, np.full(len(extra), length)]).astype(np.int64)
                cover = _cover(batch.column(1)[i].as_py(), starts, sizes)
                kept, _, lost = _kept(batch.column(2)[i].as_py().encode(), cover)
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode() if with_text else None)
                removed.append(lost)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
            )

    finished = (
        waiting.select("doc_id", "t", "n_words", "text", "gone").join(repeated, ["doc_id", "t"], "left")
        .select("doc_id", "n_words", "text", "gone", "places")
        .mapInArrow(second_pass, RESULT + ", text string")
    )
    out = done.unionByName(finished)
    return out if with_text else out.drop("text")


def _structs(rows: list, fields: tuple[str, ...]) -> pa.Array:
    """A list of structs per row from arrays of each field, null where there is no row."""
    parts = [None if r is None else (list(r.values()) if isinstance(r, dict) else list(r)) for r in rows]
    sizes = np.array([0 if p is None else len(p[0]) for p in parts], np.int64)
    flat = [
        pa.array(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts if p is not None]]).astype(np.int64))
        for k in range(len(fields))
    ]
    values = pa.StructArray.from_arrays(flat, names=list(fields))
    offsets = running(sizes).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), values, mask=pa.array([p is None for p in parts], pa.bool_())
    )
