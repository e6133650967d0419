"""Canonical exact digest of documents, in DataFrame functions only.

Canonical text: NFKC, full case folding, NFKC again, each run of white space one blank, none at the ends. Its digest is
128 bits wide (two xxhash64 with different beginnings). Documents with one digest are compared byte by byte with the
least canonical text of that digest; one that differs carries its sha-256 behind the digest, so two documents have equal
fingerprints if and only if their canonical texts are equal.

Cases: null text is empty and has the digest of the empty text; a null doc_id is the smallest; rows with one doc_id are
ordered by text; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.operators import ranges

#: Repeated digests up to this number are broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
_LEAST = -(1 << 63)


def _nfkc(c: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def canonical(text: Column) -> Column:
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), r"[\s\p{Z}\x85]+", " "))


def digest(canon: Column) -> Column:
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(canon), half(F.lit("second half"), canon))


def collisions(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, fingerprint, own: the rows whose canonical text differs from the least one of the same digest.

    digests: a table with the column fingerprint of all docs. Only texts whose digest is repeated are compared.
    """
    repeated = digests.groupBy("fingerprint").count().filter("count > 1").select("fingerprint")
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    rows = docs.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    rows = rows.join(repeated, "fingerprint", "left_semi")
    least = rows.groupBy("fingerprint").agg(F.min("canon").alias("least"))
    odd = rows.join(least, "fingerprint").filter("canon != least")
    return odd.select("doc_id", "fingerprint", F.sha2("canon", 256).alias("own")).distinct()


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each document."""
    table = common.materialise(docs.select("doc_id", digest(canonical(F.col("text"))).alias("fingerprint")), "fingerprints")
    return _resolve(table, docs)


def _resolve(table: DataFrame, docs: DataFrame) -> DataFrame:
    odd = common.materialise(collisions(docs, table), "collisions")
    if odd.isEmpty():
        return table
    # A doc_id may have several rows here; the digest names the one that is meant unless two collide under one doc_id.
    odd = odd.groupBy("doc_id", "fingerprint").agg(F.min("own").alias("own")).withColumnsRenamed({"doc_id": "_d", "fingerprint": "_f"})
    joined = table.join(odd, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fingerprint") == F.col("_f")), "left")
    return joined.withColumn("fingerprint", F.concat("fingerprint", F.coalesce(F.concat(F.lit("-"), "own"), F.lit("")))).drop("_d", "_f", "own")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_fingerprint, those of the next row by doc_id (of the first row, for the last).

    Rows are dealt to buckets of neighbouring doc_ids (several for each shuffle partition); each bucket also gets a
    copy of the first row after it. So the texts are shuffled once, and no task holds more than a bucket.
    """
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(_LEAST)))
    cuts = ranges.quantile_cuts(docs, "k", 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = ranges.with_range(docs, "k", cuts, "bucket")
    heads = sorted((r[0], r[1]) for r in docs.select("k", "bucket").groupBy("bucket").agg(F.min("k")).collect())
    if not heads:
        return docs.select("doc_id", "text", "fingerprint", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ahead = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]  # one row a bucket at most
    ahead = docs.sparkSession.createDataFrame(ahead, "k long, before int")
    first = docs.join(F.broadcast(ahead), "k").groupBy("k", "before").agg(F.min(F.struct("text", "fingerprint")).alias("h"))
    first = first.select(F.lit(None).cast("long").alias("doc_id"), F.col("h.text").alias("text"), F.col("h.fingerprint").alias("fingerprint"), "k", F.col("before").alias("bucket"), F.lit(True).alias("copy"))
    both = docs.select("doc_id", "text", "fingerprint", "k", "bucket", F.lit(False).alias("copy")).unionByName(first)
    order = Window.partitionBy("bucket").orderBy("copy", "k", "text")
    both = both.select("doc_id", "text", "fingerprint", "copy", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    return both.filter("not copy").drop("copy")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs.withColumn("fingerprint", digest(canonical(F.col("text")))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    near = near.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    near = near.withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))
    same = lambda f, t: F.when(F.col("fingerprint") != F.col(f), 0.0).when(F.col("text") == F.col(t), 1.0).otherwise((canonical(F.col("text")) == canonical(F.col(t))).cast("double"))
    out = near.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        same("edited_fingerprint", "edited").alias("near_edited"),
        same("next_fingerprint", "next_text").alias("near_next"),
    )
    return _resolve(common.materialise(out, "fingerprints"), docs)
