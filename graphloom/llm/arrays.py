"""Texts as numpy arrays: words and their 64-bit hashes without a Python loop over words."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def code_points(texts: list[str], sep: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by sep, and where each text starts (one entry more than texts)."""
    joined = sep.join(texts) + sep
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return cp, np.concatenate(([0], np.cumsum(lengths)))


def flat_index(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions start, start + 1, ... of all segments one after another, each one's place in its segment, and where each
    segment begins among them."""
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    return np.repeat(starts, lengths) + place, place, first


def segment_hash(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment cp[start:end], none of them empty.

    Each (place, code point) is mixed by itself before they are summed, so no arithmetic of the code points carries over:
    texts built against sums of powers don't collide here.
    """
    if not len(starts):
        return np.zeros(0, U)
    at, place, first = flat_index(starts, ends - starts)
    x = place.view(U)
    x <<= U(21)
    x |= cp[at]
    x += _ODD
    return mix64(np.add.reduceat(mix64(x), first) + (ends - starts).astype(U))


def same_segments(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[start:start + length] and b[start:start + length] are equal, for each segment; none is empty."""
    if not len(lengths):
        return np.zeros(0, bool)
    at, place, first = flat_index(a_starts, lengths)
    return np.logical_and.reduceat(a[at] == b[np.repeat(b_starts, lengths) + place], first)


def words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but blank, \\t, \\n, \\v, \\f, \\r. cp must end with one of those."""
    gap = (cp == 32) | ((cp - np.uint32(9)) <= 4)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(cp) and not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    return cp + np.where((cp - np.uint32(65)) <= 25, np.uint32(32), np.uint32(0))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered) in order, and each text's first word (one entry more than texts)."""
    cp, first = code_points(texts, "\n")
    s, e = words(cp)
    return segment_hash(lower_ascii(cp), s, e), np.searchsorted(s, first)


class HashTable:
    """64-bit keys to dense numbers 0, 1, 2, ...; vectorised open addressing with linear probes."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        got = self.vals[slot]
        todo = np.flatnonzero((got >= 0) & (self.keys[slot] != h))
        out = got
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            v = self.vals[slot]
            out[todo] = v
            more = (v >= 0) & (self.keys[slot] != h[todo])
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Adds distinct keys that are not yet there."""
        if (self.n + len(h)) * 4 > len(self.keys):
            filled = np.flatnonzero(self.vals >= 0)
            old, num = self.keys[filled], self.vals[filled]
            while (self.n + len(h)) * 4 > 1 << self.bits:
                self.bits += 1
            self.keys, self.vals = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
            self._put(old, num)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, num: np.ndarray) -> None:
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.vals[slot] < 0
            self.vals[slot[free]] = num[free]
            done = free & (self.vals[slot] == num)
            self.keys[slot[done]] = h[done]
            rest = ~done
            h, num, slot = h[rest], num[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
