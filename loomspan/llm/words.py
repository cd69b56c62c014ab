"""Words of many texts at once, told apart exactly and not by a hash alone.

A word is a run without ASCII white space. Up to 16 bytes it is its own key, two
numbers and its size; the key of a longer one is its size and a 128-bit BLAKE2
digest, for which no two words with equal keys are known.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SHORT = 16


class Words(NamedTuple):
    """Where words start and end, and their keys: ``a``, ``b`` and ``end - start``."""

    start: np.ndarray
    end: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return self.end - self.start

    @property
    def hash(self) -> np.ndarray:
        """64 bits of each key."""
        return hashed(self.a, self.b, self.size.astype(np.uint64))

    def take(self, rows: np.ndarray) -> Words:
        return Words(*(x[rows] for x in self))


def hashed(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = (a ^ size * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h ^ b) * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def split(data: bytes) -> Words:
    """The words of a byte string, in order."""
    space = _IS_SPACE[np.frombuffer(b" " + data + b" ", np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[0::2], edges[1::2]
    size = end - start
    eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), strides=(1,))  # the eight bytes from each place on
    a = eight[start] & _MASKS[np.minimum(size, 8)]
    b = eight[np.minimum(start + 8, len(data))] & _MASKS[np.clip(size - 8, 0, 8)]
    for k in np.flatnonzero(size > _SHORT).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]], digest_size=16).digest()
        a[k], b[k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return Words(start, end, a, b)


class WordTable:
    """Words by key to their numbers: open addressing, grows by appending."""

    def __init__(self, room: int):
        self.bits = int(room * 2).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.a, self.b = np.zeros((2, min(room, 1 << 16)), np.uint64)
        self.n = np.zeros(min(room, 1 << 16), np.int64)
        self.size = 0

    def find(self, words: Words, h: np.ndarray) -> np.ndarray:
        """The number of each word (``h``: its hash), -1 for absent ones."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        size = words.size
        open_ = np.flatnonzero((out >= 0) & ((self.a[out] != words.a) | (self.b[out] != words.b) | (self.n[out] != size)))
        while len(open_):
            at[open_] = (at[open_] + 1) & len(self.slots) - 1
            out[open_] = found = self.slots[at[open_]]
            other = (self.a[found] != words.a[open_]) | (self.b[found] != words.b[open_]) | (self.n[found] != size[open_])
            open_ = open_[(found >= 0) & other]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """New, distinct words by their keys."""
        pending = np.arange(self.size, self.size + len(a), dtype=np.int32)
        self.size += len(a)
        if self.size > len(self.a):
            room = max(self.size, 2 * len(self.a))
            for name in ("a", "b", "n"):
                own = getattr(self, name)
                setattr(self, name, np.concatenate((own, np.zeros(room - len(own), own.dtype))))
        self.a[pending], self.b[pending], self.n[pending] = a, b, n
        if self.size * 2 > len(self.slots):
            self.bits = int(self.size * 2).bit_length()
            self.slots = np.full(1 << self.bits, -1, np.int32)
            pending = np.arange(self.size, dtype=np.int32)
        h = hashed(self.a[pending], self.b[pending], self.n[pending].astype(np.uint64))
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(pending):
            free = self.slots[at] < 0
            self.slots[at[free]] = pending[free]  # of those that want a free slot, one wins
            lost = self.slots[at] != pending
            pending, at = pending[lost], (at[lost] + 1) & len(self.slots) - 1
