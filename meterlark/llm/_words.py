"""Words of many texts at once in numpy: places, hashes and rolling windows."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes that are not part of a word in `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = U64(0x9E3779B97F4A7C15)
#: Bytes of words hashed at once (one longer word is hashed alone).
HASHED_AT_ONCE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Words:
    """Words of texts laid end to end: `start`, `end` (bytes), `doc` (index of the text), `hash` (64 bits)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~BLANK[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty(n, bool)
        after[n - 1 :], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | first[:n]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.inside = inside
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        #: index of each text's first word, and one past the last word
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        if not len(self.start):
            return np.zeros(0, U64)
        size = self.end - self.start
        power = np.cumprod(np.full(int(size.max()), _ODD, U64))
        letters, ends = self.data[self.inside], np.cumsum(size)
        out, a = np.empty(len(size), U64), 0
        while a < len(size):  # a few words at a time: the numbers take far more room than the letters
            begin = ends[a] - size[a]
            b = max(a + 1, int(np.searchsorted(ends, begin + HASHED_AT_ONCE, side="right")))
            own = size[a:b]
            at = np.cumsum(own) - own
            values = letters[begin : ends[b - 1]].astype(U64)
            values += U64(1)
            values *= power[np.arange(len(values)) - np.repeat(at, own)]
            out[a:b] = np.add.reduceat(values, at) + own.astype(U64)
            a = b
        return mixed(out)

    def windows(self, hashes: np.ndarray, k: int, seed: int = 0xD6E8FEB86659FD93) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where fewer than k are left in the text (see fits)."""
        out = np.zeros(len(hashes), U64)
        factor = U64(1)
        with np.errstate(over="ignore"):
            for j in range(min(k, len(hashes))):
                out[: len(hashes) - j] += hashes[j:] * factor
                factor = factor * U64(seed)
        return mixed(out)

    def fits(self, k: int) -> np.ndarray:
        """Whether k words from each word on lie in its text."""
        return np.arange(len(self.start)) + k <= self.first[self.doc + 1]


def spans_of(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered words that don't cross texts: (text, start word in it, end word in it)."""
    n = len(covered)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], covered[:-1]]) if n else covered
    after = np.concatenate([covered[1:], [False]]) if n else covered
    start = np.flatnonzero(covered & (~before | edge[:n]))
    end = np.flatnonzero(covered & (~after | edge[1:])) + 1
    text = np.searchsorted(first, start, side="right") - 1
    return text, start - first[text], end - first[text]
