"""Token ids as binary blocks, written in ascending doc_id order and read back.

Documents are dealt out by ranges of doc_id, so file k holds smaller ids than file k + 1, and coded in blocks of whole
documents (see coder.py): each block starts with an empty model and ends in a checksum, so any block can be read, or
written again after a lost executor, by itself. A file is a Parquet file in the shared folder with one block a row.

Cases: null or empty text is the end id alone; null doc_ids come first; rows with one doc_id are ordered by text, and
repeated rows stay as often as they occur; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import coder, common
from graphloom.llm.tokens import encoder

END, VOCAB = 2, 49408
#: Ids in a block, about; the last document of a block is kept whole.
BLOCK_IDS = 1 << 21
BLOCKS = "part long, block_base long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, style: str, end: int, vocab: int) -> Iterator[pa.RecordBatch]:
    enc, part, base = encoder(tokenizer, style), TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    docs: list = []
    lengths: list[int] = []
    size = 0

    def flush() -> pa.RecordBatch:
        payload = coder.encode(np.concatenate(ids), vocab)
        return pa.RecordBatch.from_pylist(
            [{"part": part, "block_base": base, "n_ids": size, "doc_ids": docs, "lengths": lengths, "payload": payload}],
            pa.schema([("part", pa.int64()), ("block_base", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]),
        )

    for batch, texts in common.text_chunks(batches):
        flat, at = enc.encode(texts)
        ids.append(np.insert(flat, at[1:], end))
        docs += batch.column("doc_id").to_pylist()
        n = np.diff(at) + 1
        lengths += n.tolist()
        size += int(n.sum())
        if size >= BLOCK_IDS:
            yield flush()
            ids, docs, lengths, size, base = [], [], [], 0, base + size
    if docs:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch], starts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = coder.decode(row["payload"])
            n = np.array(row["lengths"], np.int64)
            if len(ids) != n.sum():
                raise ValueError("a block's documents don't add up to its ids")
            to = np.cumsum(n)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(to.tolist(), row["lengths"], strict=True)]
            base = starts[row["part"]] + row["block_base"]
            for i in range(0, len(n), 20_000):
                j = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"][j], pa.int64()), pa.array(base + to[j] - n[j]), pa.array(n[j]), pa.array(crc[j], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def write_blocks(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", style: str = "word", end: int = END, vocab: int = VOCAB) -> None:
    """Writes the ids of all documents to path (a folder all executors share)."""
    common.small_batches(docs.sparkSession)
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(lambda it: _write(it, tokenizer, style, end, vocab), BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files at path.

    The driver holds one number for each part, that is each partition of the writing shuffle.
    """
    common.small_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts, total = {}, 0
    for part, n in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts[part] = total
        total += n
    rows = blocks.select("part", "block_base", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(lambda it: _read(it, starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_root(spark)}/ids-{common.uuid.uuid4().hex}"
    write_blocks(common.documents(spark, sf_dir), path)
    return read_blocks(spark, path)
