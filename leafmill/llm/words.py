"""Words of texts and hashes of their runs, as arrays over many texts at once.

A word is a run of bytes besides U+0020 and U+0009 to U+000D in UTF-8. Texts are
laid one after another with a space after each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BETWEEN = np.zeros(256, np.bool_)
BETWEEN[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once.
PIECE = 2 << 20
_random = np.random.Generator(np.random.PCG64(20_250_207))
_bytes = _random.integers(0, 1 << 64, 256, np.uint64)
_places = _random.integers(0, 1 << 64, 1 << 16, np.uint64) | np.uint64(1)
_factors = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """hashes: of each word; first: index of each text's first word, and their number."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def place(self) -> np.ndarray:
        """Each word's index in its own text."""
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], self.counts)

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are all in its text."""
        out, size, owner = np.zeros(len(self.hashes), np.bool_), max(0, len(self.hashes) - n + 1), self.owner
        out[:size] = owner[:size] == owner[n - 1 : n - 1 + size]
        return out

    def runs(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the n words from each word on, and whether these are all in its text."""
        size = max(0, len(self.hashes) - n + 1)
        out = np.full(size, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            out += self.hashes[k : k + size] * _factors[(seed * 17 + k) % 64]
        whole = np.zeros(len(self.hashes), np.uint64)
        whole[:size] = mixed(out)
        return whole, self.inside(n)


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """lower: A-Z count as a-z."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if lower:
        data = _lower[data]
    word = ~BETWEEN[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(stops, starts[begin] + PIECE, "right")))
        own, length = starts[begin:end], stops[begin:end] - starts[begin:end]
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        value = _bytes[data[np.repeat(own, length) + place]]
        value *= _places[place & 0xFFFF] + (place >> 16).astype(np.uint64) * np.uint64(2)
        hashes[begin:end] = np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        begin = end
    return Words(mixed(hashes), np.append(np.searchsorted(starts, np.append(0, ends[:-1])), len(starts)).astype(np.int64))
