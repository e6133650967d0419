"""Adaptive context-mixing range coder for token ids, in independent blocks.

A block's ids are dealt to lanes of equal length; step t codes the t-th id of every lane, and all lanes share one
model that starts empty in each block. So numpy codes thousands of ids at once, in both directions alike.

Model of one id: the order-2 context (the two ids before it) and the order-1 context each name a candidate with a
confidence from 0 to 7. The pair of confidences (and whether the candidates agree) picks a row of adaptive weights
that mixes the three orders: the range is shared by order-2 candidate, order-1 candidate and "neither"; after
"neither" comes the id by its order-0 frequency in the block so far. A 64-bit range coder with carries writes it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
MAGIC, VERSION = b"GLTK", 1
MIX_BITS, ID_BITS, HASH_BITS = 16, 18, 18
LANES, STEPS = 4096, 512
_HEAD = struct.Struct("<4sHHIIII")
#: By "is it the order-2 candidate" + 2 * "is it the order-1 candidate": which part of the range codes it.
_KIND = np.array([2, 0, 1, 0], np.int64)
#: The next confidence, by confidence + 8 * "was it right"; a wrong candidate of confidence 0 is replaced.
_NEXT = np.array([1, 0, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.uint8)


class Model:
    def __init__(self, vocab: int):
        self.vocab = vocab
        self.cand1, self.conf1 = np.zeros(vocab, np.int32), np.zeros(vocab, np.uint8)
        self.cand2, self.conf2 = np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS, np.uint8)
        self.hits = np.tile(np.array([1, 1, 2], np.int64), 128)
        self.freq0 = np.ones(vocab, np.int64)
        self.fresh: list[np.ndarray] = []
        self.step, self.due = 0, 0
        self._weights()
        self._order0()

    def _weights(self) -> None:
        h = self.hits.reshape(128, 3)
        total = h.sum(1)
        a, b = (h[:, 0] * 65000 // total).clip(16), (h[:, 1] * 65000 // total).clip(16)
        b[1::2] = 0
        all_ = np.full(128, 1 << MIX_BITS)
        self.first = np.stack((np.zeros(128, np.int64), a, a + b), 1).astype(U).ravel()
        self.share = np.stack((a, b, all_ - a - b), 1).astype(U).ravel()

    def _order0(self) -> None:
        if self.fresh:
            self.freq0 += 32 * np.bincount(np.concatenate(self.fresh), minlength=self.vocab)
            self.fresh = []
        f = 1 + self.freq0 * ((1 << ID_BITS) - self.vocab) // self.freq0.sum()
        f[-1] += (1 << ID_BITS) - f.sum()
        self.f0 = f.astype(U)
        self.cum0 = np.concatenate(([0], np.cumsum(f)[:-1])).astype(U)
        self.symbol = np.repeat(np.arange(self.vocab, dtype=np.int32), f)

    def look(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Sets the candidates; gives each lane's row of weights, times three."""
        self.h = (((p1 * 0x9E3779B1) ^ (p2 * 0x85EBCA6B)) >> 14) & ((1 << HASH_BITS) - 1)
        self.a, self.b = self.cand2[self.h], self.cand1[p1]
        self.ca, self.cb = self.conf2[self.h], self.conf1[p1]
        self.row = ((self.ca << 4) | (self.cb << 1) | (self.a == self.b)).astype(np.int64) * 3
        return self.row

    def learn(self, x: np.ndarray, p1: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, slot: np.ndarray) -> None:
        """hit2, hit1: whether each candidate was right; slot: the row of weights and the part of it that was used."""
        new = np.flatnonzero((self.ca | hit2.view(np.uint8)) == 0)
        self.cand2[self.h[new]] = x[new]
        self.conf2[self.h] = _NEXT[self.ca + (hit2.view(np.uint8) << 3)]
        new = np.flatnonzero((self.cb | hit1.view(np.uint8)) == 0)
        self.cand1[p1[new]] = x[new]
        self.conf1[p1] = _NEXT[self.cb + (hit1.view(np.uint8) << 3)]
        self.hits += 8 * np.bincount(slot, minlength=384)
        self.fresh.append(x)
        self.step += 1
        if self.step & 3 == 0 or self.step < 8:
            self._weights()
        if self.step > self.due:
            self._order0()
            self.due = self.step + max(1, min(self.step // 2, 48))


class Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.rng = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
        self.out, self.pos = np.zeros((lanes, 2 * steps + 2), U), np.zeros(lanes, np.int64)

    def code(self, start: np.ndarray, freq: np.ndarray, bits: int, at) -> None:
        """at: a slice or an index of lanes."""
        low, r = self.low[at], self.rng[at] >> U(bits)
        new = low + r * start
        r *= freq
        over = np.flatnonzero(new < low)
        full = np.flatnonzero(r < U(1 << 32))
        lane = np.arange(at.stop) if isinstance(at, slice) else at
        if len(over):
            who = lane[over]
            self.out[who, self.pos[who] - 1] += U(1)
        if len(full):
            who = lane[full]
            part = new[full]
            self.out[who, self.pos[who]] = part >> U(32)
            self.pos[who] += 1
            new[full] = part << U(32)
            r[full] <<= U(32)
        self.low[at], self.rng[at] = new, r

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane one after another, and how many each lane has."""
        who = np.arange(len(self.low))
        for _ in range(2):
            self.out[who, self.pos] = self.low >> U(32)
            self.low <<= U(32)
            self.pos += 1
        carry, width = np.zeros(len(who), U), int(self.pos.max())
        for p in range(width - 1, -1, -1):
            col = self.out[:, p] + carry
            self.out[:, p], carry = col & U(0xFFFFFFFF), col >> U(32)
        return self.out[:, :width][np.arange(width) < self.pos[:, None]].astype("<u4"), self.pos.astype("<u4")


class Reader:
    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words = np.concatenate((words, np.zeros(1, np.uint32)))
        self.pos = np.concatenate(([0], np.cumsum(counts.astype(np.int64))[:-1])) + 2
        self.rng = np.full(len(counts), 0xFFFFFFFFFFFFFFFF, U)
        self.val = (self.words[self.pos - 2].astype(U) << U(32)) | self.words[self.pos - 1].astype(U)

    def peek(self, bits: int, at) -> tuple[np.ndarray, np.ndarray]:
        r = self.rng[at] >> U(bits)
        return self.val[at] // r, r

    def skip(self, r: np.ndarray, start: np.ndarray, freq: np.ndarray, at) -> None:
        val = self.val[at] - r * start
        r = r * freq
        full = np.flatnonzero(r < U(1 << 32))
        if len(full):
            who = full if isinstance(at, slice) else at[full]
            val[full] = (val[full] << U(32)) | self.words[self.pos[who]]
            self.pos[who] += 1
            r[full] <<= U(32)
        self.val[at], self.rng[at] = val, r


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, -(-n // STEPS)))
    steps = -(-n // lanes) if n else 0
    return (-(-n // steps), steps) if n else (0, 0)


def _active(n: int, lanes: int, steps: int, t: int) -> int:
    return lanes if t < n - (lanes - 1) * steps else lanes - 1


def encode(ids: np.ndarray, vocab: int) -> bytes:
    """A block: header, words in each lane, words, crc32 of all that. ids below vocab, vocab below 2**18."""
    n = len(ids)
    lanes, steps = _shape(n)
    head = _HEAD.pack(MAGIC, VERSION, 0, vocab, n, lanes, steps)
    body = b""
    if n:
        grid = np.zeros(lanes * steps, np.int64)
        grid[:n] = ids
        grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
        model, out = Model(vocab), Writer(lanes, steps)
        p1 = p2 = np.zeros(lanes, np.int64)
        for t in range(steps):
            k = _active(n, lanes, steps, t)
            x, p1, p2 = grid[t, :k], p1[:k], p2[:k]
            row = model.look(p1, p2)
            hit2, hit1 = x == model.a, x == model.b
            slot = row + _KIND[hit2.view(np.uint8) + 2 * hit1.view(np.uint8)]
            out.code(model.first[slot], model.share[slot], MIX_BITS, slice(0, k))
            miss = np.flatnonzero(~(hit2 | hit1))
            if len(miss):
                s = x[miss]
                out.code(model.cum0[s], model.f0[s], ID_BITS, miss)
            model.learn(x, p1, hit2, hit1, slot)
            p1, p2 = x, p1
        words, counts = out.done()
        body = counts.tobytes() + words.tobytes()
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if len(block) < _HEAD.size + 4 or struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("damaged block: checksum differs")
    magic, version, _, vocab, n, lanes, steps = _HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(block, "<u4", (len(block) - 4 - _HEAD.size) // 4, _HEAD.size)
    model, src = Model(vocab), Reader(raw[lanes:], raw[:lanes])
    grid = np.zeros((steps, lanes), np.int64)
    p1 = p2 = np.zeros(lanes, np.int64)
    for t in range(steps):
        k = _active(n, lanes, steps, t)
        p1, p2 = p1[:k], p2[:k]
        row = model.look(p1, p2)
        v, r = src.peek(MIX_BITS, slice(0, k))
        past = (v >= model.first[row + 2]).view(np.uint8)
        slot = row + past + (v >= model.first[row + 1])
        src.skip(r, model.first[slot], model.share[slot], slice(0, k))
        x = model.b.astype(np.int64)
        sure = np.flatnonzero(slot == row)
        x[sure] = model.a[sure]
        miss = np.flatnonzero(past)
        if len(miss):
            v, r = src.peek(ID_BITS, miss)
            s = model.symbol[v.astype(np.int64)]
            src.skip(r, model.cum0[s], model.f0[s], miss)
            x[miss] = s
        grid[t, :k] = x
        model.learn(x, p1, x == model.a, x == model.b, slot)
        p1, p2 = x, p1
    return np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
