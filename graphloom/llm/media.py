"""Texts as PNG images in a binary column, read back with checksum tests, and a cosine-transform hash of each.

The payload is the text's UTF-8 with zero bytes up to a positive multiple of 64: the rows of an 8-bit grey image, 64
wide. Reading tests each chunk's checksum, inflates the pixels and undoes the row filters in numpy. The feature: the image
is averaged to 32 x 32, transformed (DCT-II), and its 8 x 8 lowest frequencies become 64 bits, above the median or not.

Cases: null text is empty, a payload of 64 zero bytes; equal texts have equal values; repeated rows each get a row; a
damaged image raises ValueError; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common

WIDTH, SIDE, LOW, LEVEL = 64, 32, 8, 1
#: Of stored images: each row less the one above.
ROW_FILTER = 2
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_i = np.arange(SIDE)
_COS = np.cos(np.pi / SIDE * (_i[None, :] + 0.5) * _i[:LOW, None])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(pixels: np.ndarray, row_filter: int = 0) -> bytes:
    """An 8-bit grey PNG; row_filter 0 (none), 1 (left) or 2 (above)."""
    left, up = np.zeros_like(pixels), np.zeros_like(pixels)
    left[:, 1:], up[1:] = pixels[:, :-1], pixels[:-1]
    rows = np.empty((pixels.shape[0], pixels.shape[1] + 1), np.uint8)
    rows[:, 0] = row_filter
    rows[:, 1:] = pixels - (left if row_filter == 1 else up if row_filter == 2 else np.uint8(0))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey PNG without interlacing; ValueError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, width, height, kind = 8, [], 0, 0, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("PNG ends early")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r} differs")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey without interlacing")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError("pixels can't be inflated") from e
    if len(rows) != height * (width + 1):
        raise ValueError("PNG has too few pixels")
    rows = rows.reshape(height, width + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if not kinds.any():
        return rows
    out, above = np.empty_like(rows), np.zeros(rows.shape[1], np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
        kind, part = kinds[a], rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part, 1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(part, 0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(a, b):
                line, left, corner = [], 0, 0
                for x, up in zip(rows[i].tolist(), above.tolist(), strict=True):
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    left, corner = (x + guess) & 255, up
                    line.append(left)
                out[i] = above = np.array(line, np.uint8)
        else:
            raise ValueError(f"unknown row filter {kind}")
        above = out[b - 1]
    return out


def feature(pixels: np.ndarray) -> str:
    h, w = pixels.shape
    tall = np.add.reduceat(pixels.astype(np.float64), np.minimum(np.arange(SIDE) * h // SIDE, h - 1), axis=0)
    tall /= np.maximum(np.diff(np.append(np.arange(SIDE) * h // SIDE, h)), 1)[:, None]
    small = tall.reshape(SIDE, SIDE, w // SIDE).mean(2)
    low = (_COS @ small @ _COS.T).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.text_chunks(batches):
        media, size = [], []
        for t in texts:
            raw, n = payload(t)
            media.append(write_png(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH), ROW_FILTER))
            size.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column("media").to_pylist():
            pixels = read_png(data)
            raw = pixels.tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(pixels)))
        c = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, k) for x, k in zip(c, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: written as Parquet with a binary column in the shared folder, and read back."""
    common.small_batches(docs.sparkSession)
    return common.materialise(docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(common.documents(spark, sf_dir)).mapInArrow(_load, _OUT)
