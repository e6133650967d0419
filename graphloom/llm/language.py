"""Language of documents by a linear-chain conditional random field over words.

Each word has hashed features: its n-grams of 2 to 4 characters with its ends marked (so affixes are features of their
own) and the word itself (the lexicon). Their weights and the transitions between the labels of neighbouring words are
learned together by gradient steps on the conditional likelihood; training sequences join pieces of texts in different
languages, as code-switched text does. Forward-backward over each whole text gives each word's label probabilities; a
document's language has the largest mean over its words, which is its score.

Fitting takes a bounded sample: about SAMPLE labelled documents a language (those of least hash), and of a longer one a
passage of SAMPLE_CHARS, at a place by its hash. Texts of any number of words are learned from.

Cases: null text and text without a letter are `und` with score 0; words without letters have no features; rows without
lang aren't learned from; without any labelled row all is `und`; repeated rows each get a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.arrays import HashTable, U, code_points, mix64, segment_hash, words

BITS, SAMPLE, SAMPLE_CHARS, EPOCHS, BATCH, LENGTH, RATE = 16, 400, 20_000, 2, 256, 32, 0.3
#: Characters in a batch of training sequences (or one sequence), as unspaced text has long words.
BATCH_CHARS = 1_000_000
KEPT = 1_000_000
_LETTER = regex.compile(r"\p{L}")


def held_out(mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == rest


def features(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of each word, and each word's first feature (one entry more)."""
    n = ends - starts
    size = n + 2
    first = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(n)), size)
    pos = np.arange(first[-1]) - first[word]
    edge = (pos == 0) | (pos == size[word] - 1)
    c = np.where(edge, np.uint32(1), cp[np.minimum(starts[word] + np.maximum(pos - 1, 0), len(cp) - 1)]).astype(U)
    left = size[word] - pos
    out, who = [segment_hash(cp, starts, ends) ^ U(7)], [np.arange(len(n))]
    g = c.copy()
    for k in range(1, 4):
        at = np.flatnonzero(left > k)
        g[at] = g[at] * U(0x100000001B3) + c[at + k] + U(k)
        out.append(mix64(g[at].copy()))
        who.append(word[at])
    who = np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return (np.concatenate(out)[order] >> U(64 - BITS)).astype(np.int64), np.searchsorted(who[order], np.arange(len(n) + 1))


def _sum_rows(weights: np.ndarray, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[feats], first[:-1], axis=0) if len(feats) else np.zeros((0, weights.shape[1]), weights.dtype)


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors: e has exp(emission) by word, first each text's first word (one entry more)."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, n = first[:-1][order], n[order]
    a, b = np.empty_like(e), np.ones_like(e)
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    for t, k in enumerate(active.tolist()):
        i = at[:k] + t
        p = e[i] * (a[i - 1] @ trans if t else start)
        a[i] = p / p.sum(1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        i = at[: active[t + 1]] + t
        p = (e[i + 1] * b[i + 1]) @ trans.T
        b[i] = p / p.sum(1, keepdims=True)
    return a, b


def _shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = a * b
    return m / m.sum(1, keepdims=True) if len(m) else m


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of all words."""
    return _shares(*forward_backward(e, first, trans, start))


def expected_transitions(a: np.ndarray, b: np.ndarray, e: np.ndarray, inner: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Sum over the words `inner` of the joint probabilities of the labels of the word before and of the word."""
    left, right = a[inner - 1], e[inner] * b[inner]
    z = ((left @ trans) * right).sum(1, keepdims=True)
    return trans * ((left / z).T @ right)


def _text_words(texts: list[str]):
    cp, doc = code_points([t.lower() for t in texts], "\n")
    s, e = words(cp)
    return cp, s, e, np.searchsorted(s, doc)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans

    def predict(self, texts: list[str], store: dict) -> tuple[list[str], np.ndarray]:
        cp, s, e, first = _text_words(texts)
        h = segment_hash(cp, s, e)
        if "table" not in store or store["table"].n > KEPT:
            store["table"], store["rows"] = HashTable(18), np.ones((1 << 16, len(self.labels)), np.float32)
        table, number = store["table"], store["table"].find(h)
        new, at = np.unique(h[number < 0], return_index=True)
        if len(new):
            at = np.flatnonzero(number < 0)[at]
            score = _sum_rows(self.weights, *features(cp, s[at], e[at]))
            letter = np.array([bool(_LETTER.search(cp[x:y].tobytes().decode("utf-32-le", "replace"))) for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)], bool)
            score = np.where(letter[:, None], score - score.max(1, keepdims=True), 0)
            n = table.n
            table.add(new)
            while table.n > len(store["rows"]):
                store["rows"] = np.concatenate((store["rows"], np.ones_like(store["rows"])))
            store["rows"][n : table.n] = np.exp(np.maximum(score, -30))
            number = table.find(h)
        p = marginals(store["rows"][number].astype(np.float64), first, np.exp(self.trans), np.full(len(self.labels), 1.0))
        total = np.concatenate((np.zeros((1, len(self.labels))), np.cumsum(p, 0)))
        n = np.diff(first)
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        known = np.array([bool(_LETTER.search(t)) for t in texts], bool)
        return [self.labels[i] if k else "und" for i, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, mean.max(1).clip(0, 1), 0.0)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Adagrad on the CRF's likelihood; each training sequence joins two pieces, half of them of different languages."""
    labels = sorted(set(langs))
    n_labels = len(labels)
    weights, trans = np.zeros((1 << BITS, n_labels), np.float32), np.zeros((n_labels, n_labels))
    if n_labels < 2:
        return Model(labels, weights, trans)
    cp, s, e, first = _text_words(texts)
    y = np.repeat([labels.index(x) for x in langs], np.diff(first))
    half = LENGTH // 2
    starts = np.concatenate([np.arange(a, b, half) for a, b in zip(first[:-1], first[1:], strict=True)]).astype(int)
    sizes = np.minimum(starts + half, first[np.searchsorted(first, starts, "right")]) - starts
    chars = np.add.reduceat(e - s, starts) if len(starts) else starts
    rng = np.random.default_rng(seed)
    g_w, g_t = np.full(weights.shape, 1e-3, np.float32), np.full(trans.shape, 1e-3)
    for _ in range(EPOCHS):
        pieces, i = rng.permutation(len(starts)), 0
        while i < len(pieces):
            p = pieces[i : i + BATCH]
            p = p[: max(1, int(np.searchsorted(np.cumsum(chars[p]), BATCH_CHARS, "right")))]
            i += len(p)
            p = np.stack((p, rng.permutation(p)), 1)
            same = rng.random(len(p)) < 0.5
            p[same, 1] = np.minimum(p[same, 0] + 1, len(starts) - 1)
            size = sizes[p].reshape(-1)
            to = np.concatenate(([0], np.cumsum(size)))
            word = np.arange(to[-1]) + np.repeat(starts[p].reshape(-1) - to[:-1], size)
            f, f_first = features(cp, s[word], e[word])
            n = np.diff(f_first)
            score = _sum_rows(weights, f, f_first).astype(np.float64)
            em = np.exp(score - score.max(1, keepdims=True))
            bound = to[::2]
            a, b = forward_backward(em, bound, np.exp(trans), np.ones(n_labels))
            d = _shares(a, b)
            d[np.arange(len(word)), y[word]] -= 1
            grad = np.stack([np.bincount(f, np.repeat(d[:, j], n), 1 << BITS) for j in range(n_labels)], 1) / len(p)
            g_w += grad * grad
            weights -= (RATE * grad / np.sqrt(g_w)).astype(np.float32)
            inner = np.setdiff1d(np.arange(len(word)), bound)
            gt = expected_transitions(a, b, em, inner, np.exp(trans))
            np.add.at(gt, (y[word[inner - 1]], y[word[inner]]), -1)
            gt /= len(p)
            g_t += gt * gt
            trans -= RATE * gt / np.sqrt(g_t)
            trans = trans.clip(-8, 8)
    return Model(labels, weights, trans - trans.max())


def fit(docs: DataFrame, seen: Column) -> Model:
    """docs: doc_id, text, lang; seen: the rows to learn from."""
    over = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    place = (F.pmod(F.xxhash64("doc_id"), over + 1) + 1).cast("int")
    rows = docs.filter(seen & F.col("lang").isNotNull()).withColumn("text", F.substring("text", place, F.lit(SAMPLE_CHARS))).filter(F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    rate = F.create_map(*[F.lit(x) for k, c in sorted(counts.items()) for x in (k, min(1.0, SAMPLE / c))])
    u = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / float(1 << 53)
    sample = sorted((tuple(r) for r in rows.filter(u < rate[F.col("lang")]).select("doc_id", "lang", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    return train([r[2] for r in sample], [r[1] for r in sample])


def predict(docs: DataFrame, model: Model, keep: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row (and `extra`, the column keep, where given)."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text", (F.lit(None).cast("string") if keep is None else keep).alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, store = shared.value, {}
        for batch, texts in common.text_chunks(batches):
            lang, score = m.predict(texts, store) if m.labels else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("extra"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "extra", "lang_pred", "score"])

    kind = docs.schema["extra"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, extra {kind}, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = held_out(5, 0)
    return predict(docs, fit(docs.select("doc_id", "text", "lang"), ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
