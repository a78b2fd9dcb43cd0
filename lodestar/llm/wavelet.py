"""Token shards as wavelet matrices in compressed files.

A wavelet matrix keeps the ids of a shard as one bit plane per bit of the largest id, the
highest first; after each plane the ids with a zero bit come before those with a one. A
directory of ones per block makes rank and select quick, so that one file answers what id
stands at a place, how often an id occurs before a place, and where its k-th occurrence is.

A shard file holds whole documents in rising ``doc_id`` order, their ids and lengths.
Documents are range partitioned; copies of a row are spread by a row id. Files are written
by Spark's own writer, so a lost task is simply run again. A null or empty text has only
the end id; a null ``doc_id`` comes first; an empty table has no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.text import ragged, running, slices
from lodestar.llm.word_ids import encoder, with_end
from lodestar.sources.staging import stage, staging_path

SHARD_TOKENS = 1 << 20
ENCODE_BYTES = 1 << 20

_MAGIC = b"LWM1"
_BLOCK = 512


class WaveletMatrix:
    """Ids with access, rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray]) -> None:
        self.n = n
        self._planes = planes  # packed bits, one array of bytes per plane
        self._ones = [_block_ones(p) for p in planes]
        self._zeros = [n - int(_rank(p, o, n)) for p, o in zip(planes, self._ones, strict=True)]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n_planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        rows = ids.astype(np.uint16 if n_planes <= 16 else np.uint32)
        planes = []
        for bit in range(n_planes - 1, -1, -1):
            ones = (rows >> rows.dtype.type(bit)) & rows.dtype.type(1)
            planes.append(np.packbits(ones.view(np.uint8)[:: rows.itemsize]))
            set_ = ones.astype(bool)
            rows = np.concatenate([rows[~set_], rows[set_]])
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        """One compressed file."""
        parts = [zlib.compress(p.tobytes(), 1) for p in self._planes]
        head = struct.pack(f"<4sQI{len(parts)}Q", _MAGIC, self.n, len(parts), *map(len, parts))
        return b"".join([head, *parts])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, n, n_planes = struct.unpack_from("<4sQI", raw)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        sizes = struct.unpack_from(f"<{n_planes}Q", raw, 16)
        at, planes = 16 + 8 * n_planes, []
        for size in sizes:
            planes.append(np.frombuffer(zlib.decompress(raw[at : at + size]), np.uint8))
            at += size
        return cls(n, planes)

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes are put back from the lowest to the highest."""
        rows = np.zeros(self.n, np.uint32)
        for depth in range(len(self._planes) - 1, -1, -1):
            ones = np.unpackbits(self._planes[depth], count=self.n).astype(bool)
            zeros = self._zeros[depth]
            above = np.empty(self.n, np.uint32)
            above[~ones] = rows[:zeros]
            above[ones] = rows[zeros:] | np.uint32(1 << (len(self._planes) - 1 - depth))
            rows = above
        return rows

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint32)
        for plane, ones, zeros in zip(self._planes, self._ones, self._zeros, strict=True):
            bit = (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            before = _rank(plane, ones, at)
            at = np.where(bit == 1, zeros + before, at - before)
            out = (out << np.uint32(1)) | bit
        return out

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before a place lie below the last plane."""
        low, high = 0, end
        for depth, (plane, ones, zeros) in enumerate(zip(self._planes, self._ones, self._zeros, strict=True)):
            a, b = int(_rank(plane, ones, low)), int(_rank(plane, ones, high))
            one = (value >> (len(self._planes) - 1 - depth)) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
        return low, high

    def rank(self, value: int, end: int) -> int:
        """How often the id occurs before the place."""
        if value >> len(self._planes):
            return 0
        low, high = self._range(value, end)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 when there are fewer."""
        if value >> len(self._planes):
            return -1
        low, high = self._range(value, self.n)
        if k < 0 or low + k >= high:
            return -1
        at = low + k
        for depth in range(len(self._planes) - 1, -1, -1):
            plane, ones, zeros = self._planes[depth], self._ones[depth], self._zeros[depth]
            if at >= zeros:
                at = _select(plane, ones, at - zeros, self.n, True)
            else:
                at = _select(plane, ones, at, self.n, False)
        return at


def _block_ones(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of the plane."""
    step = _BLOCK // 8
    return running(np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), step))) if len(plane) else np.zeros(1, np.int64)


def _rank(plane: np.ndarray, ones: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Ones before each place: the directory, then the whole bytes, then the bits."""
    at = np.asarray(place, np.int64)
    flat = at.reshape(-1)
    block = flat // _BLOCK
    base = block * (_BLOCK // 8)
    byte = flat >> 3
    span = byte - base
    total = ones[block].astype(np.int64)
    if len(plane):
        counts = np.bitwise_count(plane[np.minimum(ragged(base, span), len(plane) - 1)])
        total = total + np.diff(running(counts.astype(np.int64))[running(span)])
        rest = flat & 7
        mask = (0xFF00 >> rest).astype(np.uint8)
        last = plane[np.minimum(byte, len(plane) - 1)]
        total = total + np.where(rest > 0, np.bitwise_count(last & mask), 0)
    return total.reshape(at.shape)


def _select(plane: np.ndarray, ones: np.ndarray, k: int, n: int, one: bool) -> int:
    """The place of the k-th one or zero."""
    before = ones if one else np.arange(len(ones)) * _BLOCK - ones
    block = int(np.searchsorted(before, k, "right")) - 1
    start = block * _BLOCK
    bits = np.unpackbits(plane[start // 8 : (start + _BLOCK) // 8])[: n - start] == one
    return start + int(np.flatnonzero(bits)[k - int(before[block])])


SHARD = "part int, shard int, first long, n_docs long, n_tokens long, docs binary, known binary, lengths binary, tokens binary"


def write_token_shards(
    docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", shard_tokens: int = SHARD_TOKENS
) -> str:
    """Encode whole documents and write their shards; returns the folder.

    A shard takes documents until it has ``shard_tokens`` tokens. ``first`` counts the
    tokens of the same task before the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        open_: list[tuple] = []
        held = before = shard = 0

        def close() -> pa.RecordBatch:
            doc, known, counts, ids = (np.concatenate(x) for x in zip(*open_, strict=True))
            row = (
                task, shard, before, len(doc), len(ids), doc.tobytes(), np.packbits(known).tobytes(),
                zlib.compress(counts.astype("<u4").tobytes(), 1), WaveletMatrix.build(ids).to_bytes(),
            )
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            names = [f.split()[0] for f in SHARD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for part in slices(batches, "text", ENCODE_BYTES):
            key = part.column(0)
            doc = key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            known = key.is_valid().to_numpy(zero_copy_only=False)
            ids, counts = with_end(*encoder(tokenizer).encode(part.column(1)), end_id)
            open_.append((doc, known, counts, ids))
            held += len(ids)
            if held >= shard_tokens:
                yield close()
                shard, before, held, open_ = shard + 1, before + held, 0, []
        if open_:
            yield close()

    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    sorted_ = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select(
        F.col("doc_id").cast("long"), "text"
    )
    path = staging_path(docs.sparkSession)
    sorted_.mapInArrow(run, SHARD).write.option("compression", "none").parquet(path)
    return path


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The shards with the tokens of all tasks before theirs; one row per task is summed."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return shards.join(stage(base), "part")


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32 and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(zlib.decompress(row["lengths"]), "<u4").astype(np.int64)
                known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(counts)).astype(bool)
                doc = pa.array(np.frombuffer(row["docs"], "<i8"), mask=~known)
                raw = WaveletMatrix.from_bytes(row["tokens"]).tokens().astype("<u4").tobytes()
                bounds = running(counts)
                cuts = (4 * bounds).tolist()
                ids = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc, pa.array(bounds[:-1] + row["base"] + row["first"]), pa.array(counts),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    return _numbered(spark, path).mapInArrow(run, schema)


def id_counts(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """How often some ids occur in all shards, and the place of the first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(row["tokens"])
                places = [matrix.select(i, 0) for i in ids]
                start = row["base"] + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array([matrix.count(i) for i in ids], pa.int64()),
                        pa.array([start + p if p >= 0 else None for p in places], pa.int64()),
                    ],
                    names=["id", "n", "place"],
                )

    found = _numbered(spark, path).mapInArrow(run, "id long, n long, place long")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.min("place").alias("first_place"))
