"""Token ids of whole texts, as the tokenizers library gives them.

Both tokenizer files cut a text into pieces (words, numbers, punctuation, blanks) and encode each piece by
itself. So a piece's ids are asked of the library once and kept by the piece's hash, beside its code points; the cutting
runs in numpy. Each piece found by its hash is compared with the kept one. A text with a piece that differs from the kept
one, with a character beyond the ranges below, or with the string of an added token such as <|endoftext|>, goes to the
library whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm.arrays import HashTable, code_points, flat_index, same_segments, segment_hash

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
#: Beyond this code point a text is encoded by the library itself.
LAST = 0x24F
_MARK = "￿"
#: Pieces kept. Beyond that only those met in several calls stay, or none if these are more than half. A worker keeps its
#: store for all its tasks, and while those of other operators run, too.
MOST_KEPT = 200_000
_loaded: dict[tuple[str, str], "Encoder"] = {}


def _class(c: int) -> int:
    ch = chr(c)
    kind = unicodedata.category(ch)[0]
    if ch.isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F):
        return SPACE
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in these files' vocabularies: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Encoder:
    """encode(texts) gives the flat ids of all texts and each text's first position (one entry more than texts)."""

    def __init__(self, path: str, style: str):
        self.lib, self.style = Tokenizer.from_file(path), style
        self.added = sorted({t.content.lower() for t in self.lib.get_added_tokens_decoder().values()})
        self.kind = np.array([_class(c) for c in range(LAST + 1)] + [BREAK], np.uint8)
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(LAST + 1)] + [0xFFFF], np.uint32)
        self.letters, self.tokenize = _byte_letters(), self.lib.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.table, self.flat, self.used = HashTable(18), np.zeros(1 << 20, np.uint32), 0
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.chars, self.chars_used = np.zeros(1 << 20, np.uint32), 0
        self.spelled, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)

    def _shrink(self) -> None:
        """Keeps the pieces that were met again after the call that brought them."""
        keep = np.flatnonzero(self.again[: self.table.n])
        if 2 * len(keep) > MOST_KEPT:
            self.forget()
            return
        filled = self.table.vals >= 0
        keys = np.zeros(self.table.n, self.table.keys.dtype)
        keys[self.table.vals[filled]] = self.table.keys[filled]
        count, size = self.count[keep], self.size[keep]
        flat, _, begin = flat_index(self.begin[keep], count.astype(np.int64))
        chars, _, spelled = flat_index(self.spelled[keep], size)
        flat, chars = self.flat[flat], self.chars[chars]
        self.forget()
        self.table.add(keys[keep])
        self._grow()
        own = slice(0, len(keep))
        self.begin[own], self.count[own], self.spelled[own], self.size[own] = begin, count, spelled, size
        self.flat, self.chars = _room(self.flat, len(flat)), _room(self.chars, len(chars))
        self.flat[: len(flat)], self.chars[: len(chars)] = flat, chars
        self.used, self.chars_used = len(flat), len(chars)

    def _grow(self) -> None:
        while self.table.n > len(self.begin):
            self.begin, self.count, self.spelled, self.size = (np.resize(x, 2 * len(x)) for x in (self.begin, self.count, self.spelled, self.size))
            self.again = np.concatenate((self.again, np.zeros_like(self.again)))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _odd(self, texts: list[str], cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which texts go to the library whole."""
        far = np.flatnonzero((cp > LAST) | (cp == 0x130)) if self.style == "word" else np.flatnonzero(cp > LAST)
        doc = np.searchsorted(first, far, "right") - 1
        # Whether the case counts is up to the token; the library finds out.
        low = map(str.lower, texts)
        added = [i for i, t in enumerate(low) if any(a in t for a in self.added)]
        return np.unique(np.concatenate((doc[far != first[doc + 1] - 1], np.array(added, np.int64))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, first = code_points(texts, _MARK)
        odd = self._odd(texts, cp, first)
        if len(odd):
            return self._some_whole(texts, odd)
        cp = np.minimum(cp, np.uint32(LAST + 1))
        kind = self.kind[cp]
        if self.style == "word":
            cp = self.lower[cp]
        start = self._cut(cp, kind)
        starts = np.flatnonzero(start)
        k = kind[starts]
        ends = np.concatenate((starts[1:], [len(cp)]))
        keep = k != BREAK if self.style == "byte" else (k != BREAK) & (k != SPACE)
        starts, ends = starts[keep], ends[keep]
        number = self._numbers(cp, starts, ends)
        other = self.size[number] != ends - starts
        other[~other] = ~same_segments(cp, starts[~other], self.chars, self.spelled[number[~other]], (ends - starts)[~other])
        if other.any():
            return self._some_whole(texts, np.unique(np.searchsorted(first, starts[other], "right") - 1))
        n = self.count[number].astype(np.int64)
        to = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.arange(to[-1]) + np.repeat(self.begin[number] - to[:-1], n)]
        return ids, to[np.searchsorted(starts, first)]

    def _some_whole(self, texts: list[str], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = dict(zip(which.tolist(), self._library([texts[i] for i in which]), strict=True))
        flat, at = self.encode(["" if i in whole else t for i, t in enumerate(texts)])
        parts = [whole.get(i, flat[at[i] : at[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _cut(self, cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Flags the first code point of each piece. Texts end in BREAK."""
        start = np.empty(len(cp), bool)
        start[0] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
        quote = np.flatnonzero(cp == 39)
        quote = quote[start[quote] & (kind[np.minimum(quote + 1, len(cp) - 1)] == LETTER)]
        if self.style == "word":
            start[kind == NUMBER] = True
        else:
            # The last blank of a run stands alone, or joins the piece after it if it is a plain space.
            last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
            start[last] = True
            start[last[cp[last] == 32] + 1] = False
            quote = quote[(quote == 0) | (cp[quote - 1] != 32)]
        if len(quote):
            a, b = cp[quote + 1], cp[np.minimum(quote + 2, len(cp) - 1)]
            one = np.isin(a, [115, 116, 109, 100])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            for q, size in ((quote[one], 2), (quote[two], 3)):
                start[q + 1] = False
                start[q + size] = True
        return start

    def _numbers(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = segment_hash(cp, starts, ends)
        number = self.table.find(h)
        self.again[number[number >= 0]] = True
        fresh = np.flatnonzero(number < 0)
        if not len(fresh):
            return number
        if self.table.n + len(fresh) > MOST_KEPT and self.table.n:
            self._shrink()
            number = self.table.find(h)
            fresh = np.flatnonzero(number < 0)
        new, at = np.unique(h[fresh], return_index=True)
        at = fresh[at]
        pieces = [cp[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        ids = [[t.id for t in self.tokenize(p.encode().decode("latin-1").translate(self.letters))] for p in pieces]
        n, count, size = self.table.n, np.array([len(x) for x in ids], np.int32), ends[at] - starts[at]
        self.table.add(new)
        self._grow()
        own = slice(n, self.table.n)
        self.flat = _room(self.flat, self.used + int(count.sum()))
        self.begin[own], self.count[own] = self.used + np.concatenate(([0], np.cumsum(count)[:-1])), count
        self.flat[self.used : self.used + int(count.sum())] = [x for p in ids for x in p]
        self.used += int(count.sum())
        where, _, first = flat_index(starts[at], size)
        self.chars = _room(self.chars, self.chars_used + len(where))
        self.spelled[own], self.size[own] = self.chars_used + first, size
        self.chars[self.chars_used : self.chars_used + len(where)] = cp[where]
        self.chars_used += len(where)
        number[fresh] = self.table.find(h[fresh])
        return number


def _room(x: np.ndarray, need: int) -> np.ndarray:
    return x if need <= len(x) else np.resize(x, max(need, 2 * len(x)))


def encoder(name: str, style: str) -> Encoder:
    """name: a file of public_tokenizers; style: "byte" or "word", the way that file cuts texts."""
    if (name, style) not in _loaded:
        _loaded[name, style] = Encoder(public_tokenizers.path(name), style)
    return _loaded[name, style]
