"""Vectorised hashes of words and word sequences over a run of texts."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Polynomial hashes modulo 2^64 of any run of a sequence, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 18)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (self.base, self.inverse))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values))
        return np.r_[np.uint64(0), np.cumsum(values * self.up[: len(values)])]

    def spans(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[begin]) * self.down[begin])


_BYTES = np.random.default_rng(20240229).integers(1, _MASK, 256, np.uint64, endpoint=True)
_IN_WORD, _LONG, _SHORT = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F), Rolling(0xA0761D6478BD642F)


class Words:
    """Hashes of all words of some texts, one after the other.

    ``first[i]:first[i + 1]`` are the words of text i, ``data[begin[j]:end[j]]`` is word j; words are runs of bytes outside ``space`` (by default the space
    and 0x09-0x0D), which must hold the line feed and no part of a longer UTF-8 character."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        self.data = b"\n".join([*texts, b""])
        data = np.frombuffer(self.data, np.uint8)
        inside = np.r_[False, ~space[data]]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.begin, np.r_[0, np.cumsum(lengths)])
        self._bytes = _IN_WORD.sums(_BYTES[data])
        self.hashes = _IN_WORD.spans(self._bytes, self.begin, self.end)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._sums: dict[bool, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.hashes)

    def prefixes(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word (all of a shorter one)."""
        return _IN_WORD.spans(self._bytes, self.begin, np.minimum(self.begin + n, self.end))

    def starts(self, n: int) -> np.ndarray:
        """Words from which ``n`` words of the same text run."""
        at = np.arange(len(self))
        return at[at + n <= self.first[1:][self.doc]] if len(self) else at

    def grams(self, at: np.ndarray, n: int, second: bool = False) -> np.ndarray:
        """Hash of the ``n`` words from each word ``at``; ``second`` picks an independent hash."""
        roll = _SHORT if second else _LONG
        if second not in self._sums:
            self._sums[second] = roll.sums(self.hashes)
        return roll.spans(self._sums[second], at, at + n)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` values in a row (by their upper 36 bits; the first of equals)."""
    if len(values) < width:
        return np.empty(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    best, have = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        best, have = np.minimum(best[:-step], best[step:]), have + step
    return (best & low).astype(np.int64)
