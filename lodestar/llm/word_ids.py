"""Token ids of whole texts by a lower-casing BPE tokenizer with word ends.

The tokenizer never joins what white space parts, so a text has the ids of its words one
after the other. Words of ASCII and Latin-1 letters, digits and signs need no more than
lower case, and the places where the tokenizer splits them can be seen from their bytes.
Each different piece of a slice is encoded once, all pieces in one call, and its ids are
laid out for all places of the piece with array indexing. Words with anything else (other
scripts, combining marks, apostrophes, special tokens) go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa

from lodestar.llm.remembered import RememberedIds, distinct_spans, parts
from lodestar.llm.text import (
    IS_SPACE,
    Words,
    column_words,
    per_document,
    ragged,
    running,
)

_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_TAIL = np.zeros(256, bool)
_UPPER_TAIL[0x80:0x9F] = True
_ODD = np.ones(256, bool)
_ODD[33:127] = False
_ODD[ord("'")] = True

# Byte-level models write each byte as a visible character; here in UTF-8, two bytes at most.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_CHARACTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)} | {32: " "}
_WIDTH = np.array([len(_CHARACTER[b].encode()) for b in range(256)])
_FIRST = np.array([_CHARACTER[b].encode()[0] for b in range(256)], np.uint8)
_SECOND = np.array([_CHARACTER[b].encode()[-1] for b in range(256)], np.uint8)

# Pieces encoded in a call.
_CALL = 500


class WordEncoder:
    """Encodes columns of texts; the ids are those of the tokenizer for any text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        end = spec["model"]["end_of_word_suffix"]
        vocabulary = spec["model"]["vocab"]
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for piece, i in vocabulary.items() if piece.endswith(end)]] = True
        self._pieces = Tokenizer.from_str(json.dumps(
            spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        ))
        self._known = RememberedIds()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        words = column_words(column)
        self._known.make_room()
        if not len(words.doc):
            return np.zeros(0, np.uint32), np.zeros(words.n_docs, np.int64)
        data, start, end, odd = _pieces(words)
        spans = distinct_spans(self._known, data, start, end, odd)
        new = self._known.missing(spans.keys)
        if len(new):
            at = spans.example[new]
            strange = odd[at]
            found = []
            for rows, encode in ((np.flatnonzero(~strange), self._encode_pieces), (np.flatnonzero(strange), self._encode_words)):
                if len(rows):
                    found.append((rows, *encode(data, start[at[rows]], end[at[rows]])))
            self._known.learn(spans.keys[new], spans.checks[:, new], *parts(found, len(new)))
        ids, sizes = self._known.lay_out(spans.keys, spans.which)
        return ids, per_document(sizes, np.searchsorted(start, words.offsets))

    def _encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
        """Ids of lower-case pieces; the last id of a piece is known by its word end."""
        size = end - start + 1
        joined = data[np.minimum(ragged(start, size), len(data) - 1)]
        joined[np.cumsum(size) - 1] = 32
        width = _WIDTH[joined]
        shown = np.repeat(_SECOND[joined], width)
        shown[np.cumsum(width) - width] = _FIRST[joined]
        cuts = running(np.add.reduceat(width, np.cumsum(size) - size))[::_CALL].tolist()
        raw = shown.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True) if b > a]
        encoded = self._pieces.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        stops = np.flatnonzero(self._last[ids]) + 1
        if len(stops) != len(start):
            raise ValueError("the tokenizer splits a piece, so its kind is not supported")
        return ids, np.diff(stops, prepend=0)

    def _encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8") for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        encoded = [e.ids for e in self._whole.encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), np.uint32, int(sizes.sum())), sizes


def _pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, the pieces in them, and which pieces are words to leave alone."""
    data = words.data
    after = np.append(data[1:], np.uint8(0))
    before = np.append(np.uint8(0), data[:-1])
    tail = before == 0xC3
    odd = _ODD[data] & ~((data == 0xC3) | (tail & (data >= 0x80) & (data < 0xC0)))
    odd |= (data == ord("<")) & (after == ord("|"))
    odd |= tail & ((data == 0x97) | (data == 0xB7))
    odd_word = np.diff(running(odd.astype(np.int64))[np.stack([words.start, words.end], 1)], axis=1)[:, 0] > 0
    plain = ~IS_SPACE[data]
    plain[ragged(words.start[odd_word], (words.end - words.start)[odd_word])] = False
    lower = np.where(plain, _LOWER[data] + ((tail & _UPPER_TAIL[data]).view(np.uint8) << 5), data)
    kind = _KIND[data]
    split = np.zeros(len(data), bool)
    split[1:] = plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    split[words.start] = True
    start = np.flatnonzero(split)
    word = np.searchsorted(words.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), words.end[word])
    return lower, start, end, odd_word[word]


@cache
def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, loaded once per process."""
    return WordEncoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each document."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
