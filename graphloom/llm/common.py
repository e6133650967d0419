"""Shared plumbing of the corpus operators: table access, shared folders, batch sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.store import ensure_checkpoint_dir

#: Rows in one Arrow batch sent to Python; long texts make larger rows than Spark's default expects.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only a local session gets one of its own where that is unset."""
    return ensure_checkpoint_dir(spark)


#: Paths of the tables written within settle(), innermost last.
_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    instead_of: a table of an earlier round that nothing reads any more once df is written; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        discard(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].append(path)
    return out


def settle(make: Callable[[], DataFrame], name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Materialises what make() returns, and deletes the tables it has written on the way."""
    _scopes.append([])
    try:
        out = materialise(make(), name, instead_of)
        for path in _scopes[-1][:-1]:
            _delete(out.sparkSession, path)
    finally:
        _scopes.pop()
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that no later step reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch sizes, and leaves them so: plans made later, when rows are asked for, read them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts (column "text", null: empty) have about `limit` characters."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        start, total = 0, 0
        for i, t in enumerate(texts):
            total += len(t)
            if total >= limit:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, total = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]
