"""Vectorised work on batches of UTF-8 text.

A column of texts is treated as one byte array. Words are found and hashed for a whole
slice of documents at once, so no Python object is made per word. A word is a maximal run
of characters other than space and the control characters 9 to 13, a null text has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, stream: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values of a stream."""
    start = np.uint64((stream * 0xD1342543DE82EF95 + 1) % (1 << 64))
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * _MULTIPLIER)


BYTE_HASH = seeds(256, 1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def running(values: np.ndarray) -> np.ndarray:
    """Sums of all prefixes, the empty one first."""
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


# Spans of bytes are hashed eight at a time; longer ones than this one by one.
_LONG = 512
# Spans of up to so many bytes are told apart without a hash.
EXACT = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as a number; zeros follow the last one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of many spans of bytes.

    Every eight bytes go through a bijection together with those before them. Different
    spans of equal length up to eight never collide.
    """
    size = end - start
    eights = _eights(data)
    out = mix(size.astype(np.uint64) * _MULTIPLIER + seeds(1, 100 + seed))
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(left):
        n = np.minimum(size[left] - at, 8)
        out[left] = mix(out[left] ^ (eights[start[left] + at] & _MASK[n])) + _MULTIPLIER
        at += 8
        left = left[size[left] > at]
    salt = int(seeds(1, 100 + seed)[0]).to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=salt).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def span_checks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Three numbers per span that tell spans apart: exact up to 16 bytes, beyond that the
    size, the first eight bytes and a second hash."""
    size = end - start
    eights = _eights(data)
    head = np.minimum(size, 8)
    out = np.stack([eights[start] & _MASK[head], eights[end - head] & _MASK[head], size.astype(np.uint64)])
    long = np.flatnonzero(size > EXACT)
    if len(long):
        out[1, long] = span_hashes(data, start[long], end[long], 99)
    return out


# Rabin-Karp hashes are polynomials modulo the prime 2^61 - 1; modulo a power of two long
# periodic sequences collide whatever the multiplier.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x9E3779B97F4A7C15 % ((1 << 61) - 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both less than it; in halves of 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    whole = np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0
    return _reduced(whole)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo the prime."""
    if len(_powers[0]) < n:
        prime = int(_PRIME)
        for at, base in enumerate((_BASE, pow(_BASE, -1, prime))):
            out = _powers[at]
            while len(out) < max(n, 1 << 16):
                out = np.concatenate([out, _product(out, np.full(len(out), pow(base, len(out), prime), np.uint64))])
            _powers[at] = out
    return _powers[0][:n], _powers[1][:n]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for many ranges, independent of the place."""
    power, inverse = powers(len(values) + 1)
    terms = _product(_reduced(values), power[: len(values)])
    # sums of the halves, which fit for four thousand million values
    low, high = running(terms & np.uint64(0xFFFFFFFF)), running(terms >> np.uint64(32))
    high = _reduced(high[end] - high[start])
    shifted = ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) | (high >> np.uint64(29))
    total = _reduced(_reduced(low[end] - low[start]) + shifted)
    return mix(_product(total, inverse[start]) + (end - start).astype(np.uint64) * _MULTIPLIER)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int32 if column.type == pa.string() else np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of text or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """The words of a slice of documents, in order."""

    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # where each text starts in them, and the end
    start: np.ndarray  # of each word in the bytes
    end: np.ndarray
    first: np.ndarray  # the first word of each document, and the number of words
    doc: np.ndarray  # the document of each word

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word."""
        return span_hashes(self.data, self.start, self.end, seed)

    def counts(self) -> np.ndarray:
        """Words per document."""
        return np.diff(self.first)

    def windows(self, k: int) -> np.ndarray:
        """The first word of every run of k consecutive words of one document."""
        at = np.arange(max(0, len(self.doc) - k + 1))
        return at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> Words:
    """Find the words of texts given as bytes and offsets."""
    n = len(data)
    blank = space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    after = np.ones(n, bool)
    after[:-1] = blank[1:]
    start = np.flatnonzero(~blank & (before | edge[:n]))
    end = np.flatnonzero(~blank & (after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, first, doc)


def column_words(column: pa.Array) -> Words:
    """The words of a string column."""
    return words_of(*text_bytes(column))


def per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between successive bounds."""
    return np.diff(running(flags.astype(np.int64))[bounds])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges one after the other."""
    lengths = lengths.astype(np.int64)
    total = running(lengths)
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)


def passing(batch: pa.RecordBatch, names: list[str], **new: object) -> pa.RecordBatch:
    """Some columns of a batch with new ones beside them."""
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    made = [v if isinstance(v, pa.Array) else pa.array(v) for v in new.values()]
    return pa.RecordBatch.from_arrays([*arrays, *made], names=[*names, *new])
