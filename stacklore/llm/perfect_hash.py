"""A minimal perfect hash: n distinct keys take the slots 0 to n - 1, in about four bits a key.

Keys are pairs of 64-bit hashes. They are thrown at an array of bits twice as long as they
are many; a key alone on its bit has found its place, the others go on to the next, smaller
array. A key's slot is the number of set bits before its own, which counts kept for each
word of 64 bits give at once. A key that was not among the n may get any slot or none, so
whoever stores something under a slot stores a fingerprint of the key beside it.
"""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
MOST_LEVELS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit word with its bits spread over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def fingerprints(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """32 bits that tell a key from one that was never stored."""
    return (mixed(second + mixed(first ^ _STEP)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words.astype(np.uint64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    @staticmethod
    def _places(first, second, level: int, size: int) -> np.ndarray:
        return (mixed(first + np.uint64(level) * (second | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, spread: float = 2.0) -> PerfectHash:
        """Of keys (first, second), which must be distinct."""
        sizes, bits = [], []
        while len(first):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys are repeated")
            size = 64 * max(1, -(-int(spread * len(first)) // 64))
            at = cls._places(first, second, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = ~alone[at]
            first, second = first[rest], second[rest]
        packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), packed.view("<u8"))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for one that was surely not among the keys."""
        out, left = np.full(len(first), -1, np.int64), np.arange(len(first))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + self._places(first[left], second[left], level, int(size))
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[own]] = (self.ranks[at >> 6] + before)[own]
            left = left[~own]
        return out

    def to_bytes(self) -> bytes:
        return np.r_[len(self.sizes), self.sizes].astype("<i8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        return cls(np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<u8", offset=8 * (n + 1)))
