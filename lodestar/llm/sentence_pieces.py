"""SentencePiece encoding and decoding of whole texts, many words at a time.

A text is split where a space follows another character, as no piece goes on past there.
Each different part of a slice is encoded once: parts of equal length form a matrix, and all
rows advance together. The keys of pieces are hashes of their characters in sorted order, so
a substring is looked up by its hash, taken from running sums.

A unigram model is decoded by Viterbi: for every end the best sum of scores over all starts,
with back-pointers. A BPE model is not a lattice of scores: its ids are those of merging the
best adjacent pair again and again, which a best sum of scores does not give. So for such a
model every row merges its best pair in each step, found by a row maximum, and only the two
pairs beside the merge are looked up again.

A part of more than 48 characters, as in scripts without spaces, is split wherever no piece
has the two characters next to each other, so no merge can reach over. What is still longer
forms matrices of fewer rows. Only a run of more than 4,096 characters without such a place,
like one letter again and again, goes to the library, as its merges are quadratic here.

Characters that no piece has become byte pieces. A null text is empty and has no ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.remembered import RememberedIds, distinct_spans, parts
from lodestar.llm.text import mix, per_document, ragged, running, slices, text_bytes

# Parts of more characters are split further, and beyond the second bound not by matrices.
LONGEST = 48
_MATRIX = 4096
_CELLS = LONGEST << 14
SLICE_BYTES = 2 << 20
_SPACE = 0x2581


_MULTIPLIER = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2^64, for spans as short as pieces."""
    found = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        found.append(np.cumprod(steps, dtype=np.uint64))
    return found[0], found[1]


def character_values(characters: np.ndarray) -> np.ndarray:
    return mix(characters.astype(np.uint64) + np.uint64(1))


def _span_key(sums: np.ndarray, inverse: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(sums * inverse + size.astype(np.uint64))


class PieceTable:
    """Pieces by the hash of their characters, with ids and scores."""

    def __init__(self, pieces: list[str], ids: np.ndarray, scores: np.ndarray) -> None:
        text = "".join(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        bounds = running(size)
        values = character_values(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        power, inverse = powers(len(values) + 1)
        sums = running(values * power[:-1])
        keys = _span_key(sums[bounds[1:]] - sums[bounds[:-1]], inverse[bounds[:-1]], size)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], ids[order], scores[order]
        self.longest = int(size.max(initial=1))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 for none) and scores (minus infinity) of some hashes."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ids[at], -1), np.where(known, self.scores[at], -np.inf)


class _Rows:
    """Parts of equal length, with the hash of any span of them."""

    def __init__(self, characters: np.ndarray) -> None:
        power, self._inverse = powers(characters.shape[1] + 1)
        sums = np.zeros((len(characters), characters.shape[1] + 1), np.uint64)
        np.cumsum(character_values(characters) * power[: characters.shape[1]], axis=1, out=sums[:, 1:])
        self._sums = sums

    def spans(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self._sums
        return _span_key(sums[row, end] - sums[row, start], self._inverse[start], end - start)


def merge_rows(characters: np.ndarray, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """BPE of all rows: the starts of the pieces of each row, and how many there are."""
    n, length = characters.shape
    rows = _Rows(characters)
    edges = np.broadcast_to(np.arange(length + 3), (n, length + 3)).copy()
    edges[:, length:] = length
    count = np.full(n, length)
    score = np.full((n, length + 1), -np.inf)
    for m in range(length - 1):
        here = np.arange(n)
        score[:, m] = table.look_up(rows.spans(here, np.full(n, m), np.full(n, m + 2)))[1]
    live = np.arange(n)
    columns = np.arange(length + 1)
    while len(live):
        best = score[live].argmax(1)
        live, best = (x[score[live, best] > -np.inf] for x in (live, best))
        if not len(live):
            break
        # drop the edge between the pair and the pair's own score
        shift = columns[None, :] + (columns[None, :] > best[:, None])
        edges[live[:, None], columns[None, :]] = edges[live[:, None], shift]
        count[live] -= 1
        moved = score[live[:, None], np.minimum(shift, length)]
        score[live] = moved
        score[live, length] = -np.inf
        for side in (best - 1, best):
            ok = (side >= 0) & (side + 1 < count[live])
            row, at = live[ok], side[ok]
            score[row, at] = table.look_up(rows.spans(row, edges[row, at], edges[row, at + 2]))[1]
            none = (side >= 0) & ~ok
            score[live[none], side[none]] = -np.inf
    return edges, count


def viterbi_rows(characters: np.ndarray, table: PieceTable, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """The best sum of scores of all rows, as ``merge_rows`` returns it.

    A character without a piece scores ``unknown``. Of equal sums the longest last piece wins.
    """
    n, length = characters.shape
    rows = _Rows(characters)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), np.int64)
    here = np.arange(n)
    for end in range(1, length + 1):
        starts = np.arange(max(0, end - table.longest), end)
        keys = rows.spans(here[:, None], starts[None, :], np.full((1, len(starts)), end))
        score = table.look_up(keys)[1]
        score[:, -1] = np.where(np.isinf(score[:, -1]), unknown, score[:, -1])
        total = best[:, starts] + score
        choice = total.argmax(1)
        best[:, end], back[:, end] = total[here, choice], starts[choice]
    reverse = np.full((n, length + 1), -1)
    count, at = np.zeros(n, np.int64), np.full(n, length)
    while (open_ := at > 0).any():
        at[open_] = back[here[open_], at[open_]]
        reverse[here[open_], count[open_]] = at[open_]
        count[open_] += 1
    place = count[:, None] - 1 - np.arange(length + 3)[None, :]
    edges = np.where(place >= 0, reverse[here[:, None], np.clip(place, 0, length)], length)
    return edges, count


class SentencePieces:
    """Encodes and decodes columns of texts with a model file."""

    def __init__(self, path: str, unigram: bool = False) -> None:
        from sentencepiece import SentencePieceProcessor

        self._library = model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        usual = [
            i for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        scores = np.array([model.get_score(i) for i in usual])
        self.table = PieceTable([pieces[i] for i in usual], np.array(usual), scores)
        joined = [np.frombuffer(pieces[i].encode("utf-32-le"), np.uint32).astype(np.uint64) for i in usual]
        self._pairs = np.unique(np.concatenate([np.zeros(1, np.uint64), *[(p[:-1] << np.uint64(32)) | p[1:] for p in joined]]))
        self._unigram, self._unknown = unigram, float(scores.min(initial=0.0)) - 10
        self._byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        raw = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i)
            else b"" if model.is_control(i) else p.replace(chr(_SPACE), " ").encode()
            for i, p in enumerate(pieces)
        ]
        self._bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._bounds = running(np.array([len(b) for b in raw], np.int64))
        self._known = RememberedIds()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        self._known.make_room()
        sizes = per_document((data & 0xC0) != 0x80, offsets)
        characters = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begin = running(sizes)[:-1][sizes > 0]
        characters = np.insert(np.where(characters == 32, _SPACE, characters), begin, _SPACE)
        bounds = running(sizes + (sizes > 0))
        space = characters == _SPACE
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[bounds[:-1][sizes > 0]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(characters))
        if len(at := np.flatnonzero(end - start > LONGEST)):
            inner = ragged(start[at] + 1, end[at] - start[at] - 1)
            breaks = inner[~self._within_pieces(characters[inner - 1], characters[inner])]
            start = np.sort(np.concatenate([start, breaks]))
            end = np.append(start[1:], len(characters))
        spans = distinct_spans(self._known, characters.view(np.uint8), 4 * start, 4 * end)
        new = self._known.missing(spans.keys)
        if len(new):
            at = spans.example[new]
            found = parts(self._encode_parts(characters, start[at], end[at]), len(new))
            self._known.learn(spans.keys[new], spans.checks[:, new], *found)
        ids, counts = self._known.lay_out(spans.keys, spans.which)
        return ids, per_document(counts, np.searchsorted(start, bounds))

    def _encode_parts(self, characters: np.ndarray, start: np.ndarray, end: np.ndarray) -> list:
        size, found = end - start, []
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            if length > _MATRIX:
                texts = [characters[start[r] : end[r]].astype("<u4").tobytes().decode("utf-32-le") for r in rows]
                ids = [self._encode_long(t) for t in texts]
                sizes = np.array([len(i) for i in ids], np.int64)
                found.append((rows, np.array([x for i in ids for x in i], np.uint32), sizes))
                continue
            block = max(1, _CELLS // length)
            for at in range(0, len(rows), block):
                some = rows[at : at + block]
                matrix = characters[start[some][:, None] + np.arange(length)[None, :]]
                found.append((some, *self._ids_of(matrix)))
        return found

    def _encode_long(self, text: str) -> list[int]:
        """Ids of a part by the library, which puts a space before every text."""
        if text.startswith(chr(_SPACE)):
            return self._library.encode(text[1:].replace(chr(_SPACE), " "))
        # a line feed has its own byte piece, which nothing joins
        ids = self._library.encode("\n" + text.replace(chr(_SPACE), " "))
        return ids[ids.index(int(self._byte_id[10])) + 1 :]

    def _within_pieces(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether some piece has the two characters next to each other."""
        pairs = (before.astype(np.uint64) << np.uint64(32)) | after
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return self._pairs[at] == pairs

    def _ids_of(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = matrix.shape
        if self._unigram:
            edges, count = viterbi_rows(matrix, self.table, self._unknown)
        else:
            edges, count = merge_rows(matrix, self.table)
        row = np.repeat(np.arange(n), count)
        at = np.arange(len(row)) - np.repeat(running(count)[:-1], count)
        last = at + 1 == count[row]
        begin, stop = edges[row, at], np.where(last, length, edges[row, np.minimum(at + 1, length)])
        ids, _ = self.table.look_up(_Rows(matrix).spans(row, begin, stop))
        if (ids >= 0).all():
            return ids.astype(np.uint32), count
        out, sizes = [], np.zeros(n, np.int64)
        for r, i, b in zip(row.tolist(), ids.tolist(), begin.tolist(), strict=True):
            new = [i] if i >= 0 else self._byte_id[list(chr(matrix[r, b]).encode())].tolist()
            out += new
            sizes[r] += len(new)
        return np.array(out, np.uint32), sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts in UTF-8; the space that encoding puts before a text is taken off."""
        size = self._bounds[ids + 1] - self._bounds[ids]
        raw = self._bytes[ragged(self._bounds[ids], size)].tobytes()
        cuts = running(size)[running(counts.astype(np.int64))].tolist()
        return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def sentence_pieces(path: str) -> SentencePieces:
    """The encoder of a model file, loaded once per process."""
    return SentencePieces(path)


def encode_and_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document the number of ids, their CRC-32 as little-endian uint32, and the number
    of bytes and CRC-32 of the text decoded from them; ``with_ids`` adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            model = sentence_pieces(path)
            ids, counts = model.encode(part.column(1))
            texts = model.decode(ids.astype(np.int64), counts)
            raw, cuts = ids.astype("<u4").tobytes(), (4 * running(counts)).tolist()
            packed = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [
                part.column(0), pa.array(counts), pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()),
            ]
            names = ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "text_crc32"]
            if with_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, text_crc32 long" + (", ids binary" if with_ids else "")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
