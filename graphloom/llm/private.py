"""Personal data: fixed patterns, and terms that reveal what the patterns found.

Protected entities are the matches of four patterns; the other words of a document that holds one are its terms. For an
entity e and a term t the corpus gives document frequencies and so p(e | t) = (df(e, t) + SUPPORT df(e) / N) / (df(t) +
SUPPORT): SUPPORT documents of the corpus at large stand beside those seen, so that few documents say less, but values of
one document count too. log(p(e | t) N / df(e)), the smoothed pointwise mutual information, as a share of the entity's
information log(N / df(e)) says how much of e a reader learns from t. A share of DISCLOSE or more makes each occurrence of
the term, in every document with e, a span of kind `term`; sanitise() then generalises it to its shape, or removes it
from a share of REMOVE on.

All frequencies are exact, over whole documents, and count copies of a text once. An entity of one text has df(e, t) = 1
for each of its terms, so pairs are counted only for entities of two texts or more. Frequencies are counted only for terms
of texts with an entity: a bitmap of FILTER bits, sent to all tasks, passes a superset of them, and the join after it drops
the rest. Likewise only texts whose digest is in a bitmap of repeated ones are compared, to leave out copies.

Cases: null text is empty; texts without a match have no spans; repeated rows each get a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.arrays import U, code_points, lower_ascii, segment_hash, words

KINDS = ("email", "ip", "card", "phone")
SUPPORT, DISCLOSE, REMOVE, FILTER = 3, 0.5, 0.9, 1 << 23
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never ends within a run of digits, so one can only begin where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = re.sub(r"[\x20-]", "", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_FOUND = "uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, digest binary, entities array<long>, text string, hit boolean"
_TERMS = "array<struct<s:int,f:int,share:double>>"
_MARKED = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, terms {_TERMS}, uid long, clean string"


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _free_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word outside base spans."""
    cp, _ = code_points([text], "\n")
    s, f = words(cp)
    h = segment_hash(lower_ascii(cp), s, f)
    free = np.ones(len(s), bool)
    for a, _, b in base_spans(text):
        free[np.searchsorted(f, a, "right") : np.searchsorted(s, b)] = False
    return h[free], s[free], f[free]


def _find(batches: Iterator[pa.RecordBatch], all_texts: bool) -> Iterator[pa.RecordBatch]:
    """One row for each text; the text itself goes along if it has spans, or always."""
    uid = TaskContext.get().partitionId() << 40
    for batch, texts in common.text_chunks(batches):
        rows: list[tuple] = []
        for given, text in zip(batch.column("text").to_pylist(), texts, strict=True):
            spans = base_spans(text)
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            n = [sum(x[1] == k for x in spans) for k in range(4)]
            rows.append((uid, *n, hashlib.sha256(said.encode()).hexdigest(), said, _digest(text), sorted({_entity(k, text[a:b]) for a, k, b in spans}), given if spans or all_texts else None, bool(spans)))
            uid += 1
        c = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in c[1:5]), pa.array(c[5]), pa.array(c[6]), pa.array(c[7], pa.binary()), pa.array(c[8], pa.list_(pa.int64())), pa.array(c[9], pa.string()), pa.array(c[10])], ["uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "digest", "entities", "text", "hit"])


def _bit(h: np.ndarray) -> np.ndarray:
    return (h.view(U) >> U(17)).astype(np.int64) & (FILTER - 1)


def _text_bits(texts: list[str]) -> np.ndarray:
    return _bit(np.frombuffer(b"".join(_digest(t)[:8] for t in texts), U))


def _as_words(bits: np.ndarray) -> pa.RecordBatch:
    packed = np.packbits(bits).view(np.int64)
    at = np.flatnonzero(packed)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["at", "mask"])


def _bitmap(df: DataFrame, where: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The packed bits that `where` names for the batches of df; the driver gets FILTER / 64 numbers at most."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for b in batches:
            bits[where(b)] = True
        yield _as_words(bits)

    out = np.zeros(FILTER // 64, np.int64)
    got = df.mapInArrow(mark, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[got.column("at").to_numpy()] = got.column("mask").to_numpy()
    return out.view(np.uint8)


def _longs(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(batches: Iterator[pa.RecordBatch], copies: np.ndarray) -> Iterator[pa.RecordBatch]:
    copies = np.unpackbits(copies).view(bool)
    for batch, texts in common.text_chunks(batches):
        keep = copies[_text_bits(texts)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, k in zip(texts, keep, strict=True) if k], pa.string())], ["text"])


def _frequency(batches: Iterator[pa.RecordBatch], bits: np.ndarray, copies: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Per task, terms in `bits` and how many texts hold them; without texts in `copies`."""
    bits = np.unpackbits(bits).view(bool)
    copies = np.unpackbits(copies).view(bool) if copies is not None else None
    kept, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        t, i = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
        return t, np.bincount(i, np.concatenate([n for _, n in kept])).astype(np.int64)

    for _, texts in common.text_chunks(batches):
        if copies is not None:
            texts = [t for t, k in zip(texts, copies[_text_bits(texts)], strict=True) if not k]
        if not texts:
            continue
        cp, first = code_points(texts, "\n")
        s, f = words(cp)
        h = segment_hash(lower_ascii(cp), s, f)
        doc = np.searchsorted(first, s, "right")
        keep = bits[_bit(h)]
        h, doc = h[keep], doc[keep]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        kept.append(np.unique(h[new], return_counts=True))
        size += len(kept[-1][0])
        if size > 1_000_000:
            t, n = merged()
            kept, size = [(t, n)], len(t)
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["t", "n"])
                kept, size = [], 0
    if kept:
        t, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["t", "n"])


def _text_terms(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """uid, e, t: the distinct terms in `bits` of each text, for each entity of the row."""
    bits = np.unpackbits(bits).view(bool)
    for batch, texts in common.text_chunks(batches):
        for uid, entities, text in zip(batch.column("uid").to_pylist(), batch.column("entities").to_pylist(), texts, strict=True):
            t = np.unique(_free_words(text)[0])
            t = t[bits[_bit(t)]].view(np.int64)
            for e in entities:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), uid)), pa.array(np.full(len(t), e)), pa.array(t)], ["uid", "e", "t"])


def _mark(batches: Iterator[pa.RecordBatch], clean: bool) -> Iterator[pa.RecordBatch]:
    """All spans of each row, and its text without them where that is asked for."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    for batch, texts in common.text_chunks(batches):
        spans, terms, after = [], [], []
        for base, shown, given, text in zip(batch.column("base").to_pylist(), batch.column("shown").to_pylist(), batch.column("text").to_pylist(), texts, strict=True):
            found = []
            if shown:
                share = {x["t"]: x["share"] for x in shown}
                h, s, f = _free_words(text)
                found = [{"s": a, "f": b, "share": share[t]} for t, a, b in zip(h.view(np.int64).tolist(), s.tolist(), f.tolist(), strict=True) if t in share]
            said = [(int(x.split(":")[1]), KINDS.index(x.split(":")[0]), x) for x in base.split(",") if x]
            said += [(x["s"], len(KINDS), f"term:{x['s']}:{x['f']}") for x in found]
            spans.append(",".join(x for _, _, x in sorted(said)))
            terms.append(found)
            after.append((rewrite(text, spans[-1], {x["s"]: x["share"] for x in found}) if spans[-1] else given) if clean else None)
        kind = pa.list_(pa.struct([("s", pa.int32()), ("f", pa.int32()), ("share", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(spans, pa.string()), pa.array([len(x) for x in terms], pa.int64()), pa.array(terms, kind), batch.column("uid"), pa.array(after, pa.string())], [*names, "spans", "n_term", "terms", "uid", "clean"])


def find(docs: DataFrame, clean: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term and terms of every row, uid, a key of the row,
    and, where asked for, clean, the text without what was found."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", "text")
    found = common.materialise(docs.mapInArrow(lambda it: _find(it, clean), _FOUND), "personal-data")
    texts = common.materialise(found.groupBy("digest").agg(F.count("*").alias("copies")), "distinct-texts")
    n = max(texts.count(), 2)
    copies = _bitmap(texts.filter("copies > 1").select("digest"), lambda b: _bit(np.frombuffer(b"".join(x[:8] for x in b.column(0).to_pylist()), U)))
    held = found.filter("hit").groupBy("digest").agg(F.min("uid").alias("uid"), F.first("entities").alias("entities"), F.first("text").alias("text"))
    held = common.materialise(held, "texts-with-entities")
    entity = common.materialise(held.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("df_e")), "entities")
    at = held.select("uid", F.explode("entities").alias("e")).join(entity, "e")
    # All entities of one text are alike there: one pair, under e = 0, stands for them.
    at = at.groupBy("uid").agg(F.array_distinct(F.collect_list(F.when(F.col("df_e") > 1, F.col("e")).otherwise(F.lit(0)))).alias("entities"))
    held = held.drop("entities").join(at, "uid")
    wanted = _bitmap(held.select("text"), lambda b: _bit(np.concatenate([_free_words(t)[0] for t in b.column(0).to_pylist()] or [np.zeros(0, U)])))
    shared = spark.sparkContext.broadcast((wanted, copies))
    once = docs.mapInArrow(lambda it: _frequency(it, *shared.value), "t long, n long")
    more = docs.mapInArrow(lambda it: _repeated(it, shared.value[1]), "text string").distinct().mapInArrow(lambda it: _frequency(it, shared.value[0], None), "t long, n long")
    term = common.materialise(once.unionByName(more).groupBy("t").agg(F.sum("n").alias("df_t")), "term-frequencies")

    def share(df: Column, df_e: Column) -> Column:
        return F.log((df * float(n) / df_e + SUPPORT) / (F.col("df_t") + SUPPORT)) / F.log(F.lit(float(n)) / df_e)

    alone = term.withColumn("share", share(F.lit(1), F.lit(1))).filter(F.col("share") >= DISCLOSE).select("t", "share")
    rare = spark.sparkContext.broadcast(_bitmap(alone.select("t"), lambda b: _bit(_longs(b, "t"))))
    pair = "uid long, e long, t long"
    one = held.filter("array_contains(entities, 0L)").withColumn("entities", F.array(F.lit(0).cast("long"))).mapInArrow(lambda it: _text_terms(it, rare.value), pair)
    one = one.join(alone, "t").select("uid", "t", "share")
    several = held.withColumn("entities", F.array_remove("entities", F.lit(0).cast("long"))).filter("size(entities) > 0").mapInArrow(lambda it: _text_terms(it, shared.value[0]), pair)
    shown = several.groupBy("e", "t").agg(F.count("*").alias("df")).join(term, "t").join(entity, "e").filter(F.col("df_e") < n)
    shown = shown.withColumn("share", share(F.col("df"), F.col("df_e"))).filter(F.col("share") >= DISCLOSE).select("e", "t", "share")
    several = several.join(common.materialise(shown, "disclosing-pairs"), ["e", "t"]).select("uid", "t", "share")
    hit = one.unionByName(several).groupBy("uid", "t").agg(F.max("share").alias("share")).groupBy("uid").agg(F.collect_list(F.struct("t", "share")).alias("shown"))
    hit = held.select("uid", "digest").join(hit, "uid").select("digest", "shown")
    return found.join(hit, "digest", "left").select("uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "text", "shown").mapInArrow(lambda it: _mark(it, clean), _MARKED)


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "x", re.sub(r"\d", "9", word)))


def rewrite(text: str, spans: str, share: dict[int, float] | None = None) -> str:
    """The text with base spans as <kind>, terms as their shape, or gone where their share is REMOVE or more."""
    out, end = [], 0
    for x in filter(None, (spans or "").split(",")):
        kind, a, b = x.split(":")
        a, b = int(a), int(b)
        if a < end:
            end = max(end, b)
            continue
        put = f"<{kind}>" if kind != "term" else "" if (share or {}).get(a, 0) >= REMOVE else _shape(text[a:b])
        out += [text[end:a], put]
        end = b
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row, without personal data; a null text stays null."""
    return find(docs, clean=True).select("doc_id", F.col("clean").alias("text"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.documents(spark, sf_dir)).drop("terms", "uid", "clean")
