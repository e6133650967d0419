"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + pairwise), where the pairwise interactions of all features come in linear time from
the sum-of-squares identity: half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Features: each hashed word's share
of the text, statistics of characters, words and lines, and the text's length as metadata. Labels, lang, source and
doc_id are never features.

Fitting takes a bounded sample: about SAMPLE labelled documents of each label (by hash), of at most SAMPLE_CHARS.

Cases: null text is empty; empty texts have a score like any other; labels that are null aren't learned from; without
labels every score is 0.5; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.arrays import U, code_points, lower_ascii, segment_hash, words
from graphloom.llm.language import held_out

BITS, FACTORS, SAMPLE, SAMPLE_CHARS, EPOCHS, BATCH, RATE, DECAY, CUT = 18, 8, 2500, 40_000, 12, 128, 0.05, 1e-4, 0.7
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "'\"()-"]
CLASSES = len(_GROUPS) + 2
STATS = CLASSES + 9


def _classes() -> np.ndarray:
    table = np.full(256, len(_GROUPS), np.int64)
    table[128:] = len(_GROUPS) + 1
    for i, g in enumerate(_GROUPS):
        table[[ord(c) for c in g]] = i
    return table


_TABLE = _classes()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and share of each text's distinct words, each text's first one (one entry more), and its statistics."""
    cp, first = code_points(texts, "\n")
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(first))
    kinds = np.bincount(doc * CLASSES + _TABLE[np.minimum(cp, 255)], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    kinds[:, 4] -= 1  # the separator
    chars = np.maximum(np.diff(first) - 1, 1)[:, None]
    s, e = words(cp)
    at = np.searchsorted(s, first)
    count = np.maximum(np.diff(at), 1)
    word_doc = doc[s]
    bucket = (segment_hash(lower_ascii(cp), s, e) >> U(64 - BITS)).astype(np.int64)
    key, times = np.unique((word_doc << BITS) | bucket, return_counts=True)
    where = np.searchsorted(key >> BITS, np.arange(n + 1))
    share = times / count[key >> BITS]
    last = cp[e - 1]
    upper = lambda c: (c - np.uint32(65)) <= 25
    by = lambda x: np.bincount(word_doc, x, n) / count
    long_ = np.zeros(n)
    np.maximum.at(long_, word_doc, e - s)
    top = np.zeros(n)
    np.maximum.at(top, key >> BITS, share)
    more = [np.log1p(np.diff(at)), by((e - s).astype(float)), np.log1p(long_), np.diff(where) / count, top, by(upper(cp[s]) & upper(last)), by(_TABLE[np.minimum(last, 255)] >= 5), by(e - s == 1), np.log1p(kinds[:, 4])]
    return key & ((1 << BITS) - 1), np.sqrt(share), where, np.concatenate((kinds / chars, np.stack(more, 1)), 1)


class Machine:
    def __init__(self, seed: int = 5):
        self.seed, n = seed, (1 << BITS) + STATS
        self.w0, self.w, self.v = 0.0, np.zeros(n, np.float32), np.zeros((n, FACTORS), np.float32)
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def rows(self, f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index and value of all features, and each text's first (one entry more)."""
        bucket, share, where, stats = f
        z = ((stats - self.mean) / self.scale).clip(-4, 4)
        n = np.diff(where)
        first = np.concatenate(([0], np.cumsum(n + STATS)))
        index, value = np.empty(first[-1], np.int64), np.empty(first[-1], np.float32)
        own = (first[:-1, None] + np.arange(STATS)).ravel()
        index[own], value[own] = np.tile((1 << BITS) + np.arange(STATS), len(n)), z.ravel()
        to = np.arange(where[-1]) + np.repeat(first[:-1] + STATS - where[:-1], n)
        index[to], value[to] = bucket, share
        return index, value, first

    def margin(self, index, value, first):
        s = np.add.reduceat(self.v[index] * value[:, None], first[:-1], axis=0)
        q = np.add.reduceat((self.v[index] * value[:, None]) ** 2, first[:-1], axis=0)
        return self.w0 + np.add.reduceat(self.w[index] * value, first[:-1]) + 0.5 * (s * s - q).sum(1), s

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.margin(*self.rows(features(texts)))[0].clip(-30, 30).astype(float)))

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 11) -> "Machine":
        parts = [features(texts[i : i + 100]) for i in range(0, len(texts), 100)]
        where = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
        f = (*(np.concatenate([p[k] for p in parts]) for k in (0, 1)), where, np.concatenate([p[3] for p in parts]))
        self.mean, self.scale = f[3].mean(0), f[3].std(0) + 1e-6
        index, value, first = self.rows(f)
        self.v = np.random.default_rng(self.seed).normal(0, 0.02, self.v.shape).astype(np.float32)
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-3, np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                pick = order[i : i + BATCH]
                n = first[pick + 1] - first[pick]
                own = np.concatenate(([0], np.cumsum(n)))
                at = np.arange(own[-1]) + np.repeat(first[pick] - own[:-1], n)
                j, x = index[at], value[at]
                m, s = self.margin(j, x, own)
                err = ((1 / (1 + np.exp(-m.clip(-30, 30)))) - y[pick]).astype(np.float32) / len(pick)
                each = np.repeat(err, n)
                used, back = np.unique(j, return_inverse=True)
                d = np.bincount(back, each * x, len(used)).astype(np.float32) + DECAY * self.w[used]
                dv = (each * x)[:, None] * (np.repeat(s, n, axis=0) - self.v[j] * x[:, None])
                dv = np.stack([np.bincount(back, dv[:, k], len(used)) for k in range(FACTORS)], 1).astype(np.float32) + DECAY * self.v[used]
                gw[used] += d * d
                gv[used] += dv * dv
                g0 += float(err.sum()) ** 2
                self.w[used] -= RATE * d / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.w0 -= RATE * float(err.sum()) / g0**0.5
        return self


def fit(docs: DataFrame, labels: DataFrame, seen: Column) -> Machine:
    """docs: doc_id, text; labels: doc_id, quality; seen: the rows of both to learn from (a condition on doc_id)."""
    labels = labels.filter(seen & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    if not counts:
        return Machine()
    u = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id"), 11) / float(1 << 53)
    rate = F.create_map(*[F.lit(x) for k, c in sorted(counts.items()) for x in (k, min(1.0, SAMPLE / c))])
    picked = labels.filter(u < rate[F.col("quality")])  # about 2 * SAMPLE rows
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()
    rows = sorted(((r.doc_id, r.text or "", r.quality) for r in rows))
    return Machine().fit([r[1] for r in rows], np.array([r[2] for r in rows], np.float32)) if rows else Machine()


def score(docs: DataFrame, model: Machine) -> DataFrame:
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(shared.value.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = held_out(4, 2)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
