"""Token ids of pieces of text that a process has met, in sorted arrays.

A piece is found by a hash of its bytes and confirmed by ``span_checks`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestar.llm.text import ragged, running, span_checks, span_hashes


class RememberedIds:
    """Maps 64-bit keys to runs of ids; starts afresh beyond ``most`` keys."""

    def __init__(self, most: int = 600_000) -> None:
        self._most = most
        self.seed = 0
        self.forget()

    def forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._checks = np.zeros((3, 0), np.uint64)
        self._first = self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def make_room(self) -> None:
        """Forget all when there is too much; not between ``missing`` and ``look_up``."""
        if len(self._keys) > self._most:
            self.forget()

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        if not len(self._keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, at, -1)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are not remembered."""
        return np.flatnonzero(self._rows(keys) < 0)

    def agrees(self, keys: np.ndarray, checks: np.ndarray) -> bool:
        """Whether all of the keys that are remembered stand for the same pieces."""
        at = self._rows(keys)
        met = at >= 0
        return bool((self._checks[:, at[met]] == checks[:, met]).all())

    def learn(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Remember new keys in rising order; their ids are ids[first : first + size]."""
        to = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, to, keys)
        self._checks = np.insert(self._checks, to, checks, axis=1)
        self._first = np.insert(self._first, to, first + len(self._ids))
        self._size = np.insert(self._size, to, size)
        self._ids = np.concatenate([self._ids, ids.astype(np.uint32)])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys one after the other, and how many each has."""
        at = self._rows(keys)
        return self._ids[ragged(self._first[at], self._size[at])], self._size[at]

    def lay_out(self, keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``look_up`` of keys[which], with one search per different key."""
        at = self._rows(keys)[which]
        return self._ids[ragged(self._first[at], self._size[at])], self._size[at]


@dataclass
class DistinctSpans:
    """The different spans of a slice: their keys in rising order, an example of each, and
    which of them every span is."""

    keys: np.ndarray
    checks: np.ndarray
    example: np.ndarray
    which: np.ndarray


def distinct_spans(known: RememberedIds, data: np.ndarray, start: np.ndarray, end: np.ndarray, mark: np.ndarray | None = None) -> DistinctSpans:
    """The different spans; spans with another ``mark`` are different.

    When two spans share a key here or with a remembered one, all is hashed anew with the
    next seed and the remembered ones are forgotten.
    """
    checks = span_checks(data, start, end)
    if mark is not None:
        checks[2] = checks[2] * np.uint64(2) + mark.astype(np.uint64)
    while True:
        hashes = span_hashes(data, start, end, known.seed)
        if mark is not None:
            hashes ^= mark.astype(np.uint64)
        keys, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        own = checks[:, example]
        if (own[:, which] == checks).all() and known.agrees(keys, own):
            return DistinctSpans(keys, own, example, which)
        known.forget()
        known.seed += 1


def parts(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join (rows, ids, sizes) of several groups of rows: ids, first and size by row."""
    first, size, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for rows, ids, sizes in found:
        first[rows], size[rows] = at + running(sizes)[:-1], sizes
        at += len(ids)
    return np.concatenate([np.zeros(0, np.uint32), *[ids for _, ids, _ in found]]), first, size
