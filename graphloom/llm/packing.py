"""Packing documents into fixed windows of token ids: best-fit decreasing.

A document is its ids plus an end id. It is first cut into full windows; the rest goes, longest first, into the
open window with the least room that still holds it. A segment tree over room finds that window.

Each partition of the input packs its own documents, so nothing is shuffled and at most the last windows of each
partition have room left. A task holds its documents' remainders only (a few numbers each).

Cases: null or empty text is the end id alone; a null doc_id is packed like any other; repeated rows are packed as
often as they occur; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common
from graphloom.llm.tokens import encoder

WINDOW, END = 1024, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"


class RoomTree:
    """Open windows by their room; tightest(need) is the least room of at least need that an open window has."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.open[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.windows[room].pop()

    def tightest(self, need: int) -> int | None:
        node, tree = self.size + need, self.open
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window and offset of each piece (0 < length <= window), and the used length of each window."""
    tree, used = RoomTree(window), []
    to, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room is None:
            room, w = window, len(used)
            used.append(0)
        else:
            w = tree.take(room)
        to[i], offset[i] = w, used[w]
        used[w] += need
        if room > need:
            tree.put(room - need, w)
    return to, offset, np.array(used, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, style: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    enc, base, full = encoder(tokenizer, style), TaskContext.get().partitionId() << 40, 0
    # Remainders: doc_ids, and start, length, crc and tokens as numbers, 40 bytes each.
    rest: list[tuple[pa.Array, np.ndarray]] = []

    def rows(doc, start, length, crc, tokens, seq, offset, used):
        used = np.asarray(used)
        padded = np.where(used & (used - 1), window, used)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, tokens, base + np.asarray(seq), offset, used, padded)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to"])

    for batch, texts in common.text_chunks(batches):
        ids, at = enc.encode(texts)
        raw, out = memoryview(ids.astype("<u4").tobytes()), []
        tail = end.to_bytes(4, "little")
        docs = batch.column("doc_id").cast(pa.int64())
        left = np.zeros((4, len(texts)), np.int64)
        for i, (doc, a, b) in enumerate(zip(docs.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
            n = b - a + 1
            for s in range(0, n - n % window, window):
                e = s + window
                crc = zlib.crc32(raw[4 * (a + s) : 4 * min(a + e, b)])
                out.append((doc, s, window, zlib.crc32(tail, crc) if e == n else crc, n, full, 0, window))
                full += 1
            if n % window:
                s = n - n % window
                left[:, i] = s, n - s, zlib.crc32(tail, zlib.crc32(raw[4 * (a + s) : 4 * b])), n
        if out:
            yield rows(*zip(*out, strict=True))
        short = np.flatnonzero(left[1])
        rest.append((docs.take(pa.array(short)), left[:, short]))
    if rest:
        docs = pa.chunked_array([d for d, _ in rest], pa.int64())
        start, length, crc, tokens = np.concatenate([x for _, x in rest], 1)
        to, offset, used = best_fit(length, window)
        for i in range(0, len(docs), 50_000):
            j = slice(i, i + 50_000)
            yield rows(docs[j].combine_chunks(), start[j], length[j], crc[j], tokens[j], full + to[j], offset[j], used[to[j]])


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", style: str = "byte", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row for each piece of each document; see the module's text for the cases."""
    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _pack(it, tokenizer, style, window, end), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
