"""Exact n-gram Jaccard join by set relations: skipping index blocks, and answers derived from a similar set's answers.

A document's set is its distinct 5-word shingles (words are runs of non-blanks with A-Z lowered). Texts of one sequence of
words (128 bits of blake2b) are one node, and each task sends it once. Sets are ordered by a global order, rare shingles
first, so two sets with Jaccard >= 0.8 share a shingle among their first n - ceil(0.8 n) + 1; only those go to the index
lists. Set relations then replace the pairs within a list:

 * a list's leader is the set that holds the shingle earliest (the one with the fewest shingles of its own), and each
   other set is compared with the leader; lists whose sets are all in one component are skipped whole;
 * what is left of a list is cut into blocks of like size and position, and blocks are joined before sets: a pair of
   blocks whose bounds can't reach 0.8, or that one component holds, is skipped with all its sets;
 * where two sets of what is left follow one leader, their intersection is derived from how each of them differs from
   it, which the comparison with the leader has stored, and pairs below 0.8 go without a look at their texts.

All pairs that count as links are verified on whole texts: a batch's word and shingle hashes are checked to tell its words
and shingles apart, else the words themselves are compared. No list, group or candidate is capped; the order only steers the work.

The order comes from all shingles: each partition counts those it meets twice in a table of SLOTS counters; the sum over
partitions is SLOTS bytes (log2 of the counts), whatever the input's size, and is sent to all tasks.

Cases: null text or text without words has no set and links with nothing, its component is its own doc_id; fewer than
five words are one shingle; repeated rows each get a row; rows of one doc_id with different texts link by their texts
alone; a row without doc_id links like any other, but a component is named by its least doc_id that isn't null (null if
there is none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.arrays import U, code_points, lower_ascii, mix64, same_segments, segment_hash, word_hashes, words

WORDS, NUM, DEN = 5, 80, 100
SLOTS, CHUNKS, FLUSH = 1 << 20, 64, 3_000_000
#: Texts up to this number are picked by a broadcast of their keys (56 bytes each); more by a shuffle.
BROADCAST_NODES = 200_000
LEADER_ROUNDS = 2
#: Shingles of this level (log2 of the repetitions counted) or more are hot: their rows are dealt over SALTS tasks, and all
#: are kept. Of other shingles those of one set alone are dropped.
HOT, SALTS = 10, 64
#: Keys of texts that a task remembers; it forgets them beyond that, and then sends some text twice.
MOST_MET = 500_000
_FOUND_NAMES = ["doc_id", "md5", "n", "d1", "d2", "chunk", "counts"]
_FOUND = "doc_id long, md5 string, n long, d1 long, d2 long, chunk int, counts binary"
_KNOWN = "a long, b long, shared long, together long, gone array<long>, extra array<long>"


def _runs(h: np.ndarray, first: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and number of words of each shingle of texts whose words h begin at first (one entry more)."""
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.arange(int(m.sum())) + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(m)[:-1])), m)
    size = np.repeat(np.minimum(n, k), m)
    s = size.astype(U)
    for j in range(k):
        w = h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else h
        s = np.where(j < size, mix64(s * U(0x100000001B3) + w), s)
    return s, at, size


def shingle_sets(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each begins (one entry more)."""
    h, first = word_hashes(texts)
    s, at, _ = _runs(h, first, k)
    doc = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    return s, np.searchsorted(doc, np.arange(len(texts) + 1))


def canonical(text: str) -> bytes:
    """The text's words in order, A-Z lowered, one blank between them: of bytes, lower() and split() mean ASCII alone."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def _keys(texts: list[str]) -> list[bytes]:
    return [hashlib.blake2b(canonical(t), digest_size=16).digest() for t in texts]


def _halves(keys: list[bytes]) -> list[pa.Array]:
    x = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return [pa.array(x[:, 0]), pa.array(x[:, 1])]


def _md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _slot(s: np.ndarray) -> np.ndarray:
    return (s & U(SLOTS - 1)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and key of each row; last, the task's counters. A text that the task has met is not cut into shingles again."""
    counts, waiting, held = np.zeros(SLOTS, np.int64), [], 0
    met: dict[bytes, int] = {}

    def count() -> None:
        h = np.sort(np.concatenate(waiting))
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        times = np.diff(np.concatenate((edge, [len(h)])))
        more = times > 1
        np.add.at(counts, _slot(h[edge[more]]), times[more])

    for batch, texts in common.text_chunks(batches):
        keys = _keys(texts)
        fresh = {k: i for i, k in enumerate(keys) if k not in met}
        s, first = shingle_sets([texts[i] for i in fresh.values()])
        if len(met) > MOST_MET:
            met = {k: met[k] for k in keys if k in met}
        met.update(zip(fresh, np.diff(first).tolist(), strict=True))
        waiting.append(s)
        held += len(s)
        if held > FLUSH:
            count()
            waiting, held = [], 0
        n = len(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("md5"), pa.array([met[k] for k in keys], pa.int64()), *_halves(keys), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _FOUND_NAMES)
    if held:
        count()
    if counts.any():
        parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(counts, CHUNKS)]
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(CHUNKS, pa.string()), none, none, none, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], _FOUND_NAMES)


def _levels(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64) for c in pdf["counts"])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "levels": [np.floor(np.log2(total + 1)).astype(np.uint8).tobytes()]})


def _prefixes(batches: Iterator[pa.RecordBatch], levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """h, pos, n, d1, hot: the prefix of each set, rarest shingle first, with the first half of its text's key, and
    whether the order counts h often; of texts that the task has met, nothing more."""
    met: set[bytes] = set()
    for _, texts in common.text_chunks(batches):
        fresh = {k: t for k, t in zip(_keys(texts), texts, strict=True) if k not in met}
        met = (met if len(met) <= MOST_MET else set()) | fresh.keys()
        s, first = shingle_sets(list(fresh.values()))
        n = np.diff(first)
        doc = np.repeat(np.arange(len(fresh)), n)
        level = levels[_slot(s)]
        order = np.lexsort((s, level, doc))
        s, level = s[order].view(np.int64), level[order]
        take = np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)
        pos = np.arange(len(s)) - first[:-1][doc]
        keep = pos < take[doc]
        doc = doc[keep]
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(n[doc].astype(np.int32)), _halves(list(fresh))[0].take(pa.array(doc)), pa.array(level[keep] >= HOT)], ["h", "pos", "n", "d1", "hot"])


def plain_shingles(text: str) -> set[tuple[bytes, ...]]:
    w = canonical(text).split(b" ") if text.strip(" \t\n\v\f\r") else []
    return {tuple(w[i : i + WORDS]) for i in range(max(len(w) - WORDS, 0) + 1)} if w else set()


def _told_apart(texts: list[str]) -> bool:
    """Whether no two different words, and no two different runs of word hashes, of these texts share a hash."""
    cp, first = code_points(texts, "\n")
    cp = lower_ascii(cp)
    s, e = words(cp)
    h = segment_hash(cp, s, e)
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    size, other = e - s, at[back]
    if (size != size[other]).any() or not same_segments(cp, s, cp, s[other], size).all():
        return False
    run, start, length = _runs(h, np.searchsorted(s, first))
    _, at, back = np.unique(run, return_index=True, return_inverse=True)
    a, b = start, start[at[back]]
    if (length != length[at[back]]).any():
        return False
    return all((h[a + np.minimum(j, length - 1)] == h[b + np.minimum(j, length - 1)]).all() for j in range(WORDS))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of each pair's sets, exact: hashes stand for shingles only where they are told
    apart in the batch. Of sets that share half or more, gone and extra say how b's set differs from a's."""
    for batch in batches:
        d = batch.to_pydict()
        texts: dict[int, str] = {}
        for side in ("a", "b"):
            for i, t in zip(d[side], d[f"text_{side}"], strict=True):
                texts.setdefault(i, t or "")
        where = {i: k for k, i in enumerate(texts)}
        s, first = shingle_sets(list(texts.values()))
        exact = _told_apart(list(texts.values()))
        shared, together, gone, extra = [], [], [], []
        for a, b in zip(d["a"], d["b"], strict=True):
            x, y = (s[first[where[i]] : first[where[i] + 1]] for i in (a, b))
            if exact:
                both = np.intersect1d(x, y, assume_unique=True)
                c, union = len(both), len(x) + len(y) - len(both)
            else:
                p, q = plain_shingles(texts[a]), plain_shingles(texts[b])
                both, c, union = np.zeros(0, U), len(p & q), len(p | q)
            near = exact and 2 * c >= union
            shared.append(c)
            together.append(union)
            gone.append(np.setdiff1d(x, both, assume_unique=True).view(np.int64) if near else None)
            extra.append(np.setdiff1d(y, both, assume_unique=True).view(np.int64) if near else None)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(together, pa.int64()), pa.array(gone, pa.list_(pa.int64())), pa.array(extra, pa.list_(pa.int64()))], ["a", "b", "shared", "together", "gone", "extra"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reached) for links a, b: least labels of neighbours, then of the label itself."""
    both = common.materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = common.materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = common.materialise(step.join(jump, "comp", "left").select("node", "old", F.least("comp", "far").alias("comp")), "labels", label)
        label = step
        if step.filter("old != comp").isEmpty():
            common.discard(both)
            return step.select("node", "comp")


#: Whether two sets of n_x and n_y shingles can reach the threshold by size, and by what is left behind a shingle that
#: stands at pos_x and pos_y, the earliest they may share.
_REACH = "100 * least(n_x, n_y) >= 80 * greatest(n_x, n_y) AND 180 * least(n_x - pos_x, n_y - pos_y) >= 80 * (n_x + n_y)"


def _leader_pairs(lists: DataFrame, label: DataFrame) -> DataFrame:
    """x, y: the leader of each list that isn't within one component, and each set of another component."""
    rows = lists.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lead = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("pos", "n", "node", "comp")).alias("l")).filter("lo < hi")
    rows = rows.join(lead.select("h", "l"), "h").filter("comp != l.comp")
    rows = rows.selectExpr("node AS y", "n AS n_y", "pos AS pos_y", "l.node AS x", "l.n AS n_x", "l.pos AS pos_x").filter(_REACH)
    return rows.select("x", "y").distinct()


def _rest_pairs(lists: DataFrame, label: DataFrame, known: DataFrame) -> DataFrame:
    """x, y: what lists still hold, by blocks of like size and position.

    A list's blocks are joined first, as one row each with its bounds: two whose bounds can't reach the threshold, or
    that lie within one component, are skipped with all their sets. Then the sets of the blocks that are left. Where
    both sets follow one leader, their intersection is derived from the leader's answers (see _derived).
    """
    home = known.filter("gone IS NOT NULL").groupBy("b").agg(F.min(F.struct("a", (F.col("shared") + F.size("gone")).alias("n_led"), "gone", "extra")).alias("v"))
    home = home.selectExpr("b AS node", "v.*").withColumnRenamed("a", "led")
    rows = lists.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    block = F.struct(F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int").alias("size"), F.floor(F.log2(F.col("pos") + 1)).cast("int").alias("at"))
    rows = common.materialise(rows.join(mixed, "h").select("h", "node", "n", "pos", "comp", block.alias("block")), "mixed-lists")
    blocks = rows.groupBy("h", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("left"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = (blocks.select("h", *[F.col(c).alias(f"{c}_{k}") for c in blocks.columns if c != "h"]) for k in "xy")
    x = x.withColumn("size", F.explode(F.array(F.col("block_x.size"), F.col("block_x.size") + 1)))
    y = y.withColumn("size", F.col("block_y.size"))
    may = x.join(y, ["h", "size"]).filter(
        "(block_x.size < block_y.size OR block_x.at <= block_y.at) AND (lo_x != hi_x OR lo_y != hi_y OR lo_x != lo_y)"
        " AND 100 * most_x >= 80 * least_y AND 100 * most_y >= 80 * least_x AND 180 * least(left_x, left_y) >= 80 * (least_x + least_y)"
    )
    may = may.select("h", "block_x", "block_y")
    x, y = (rows.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "node", "n", "pos", "comp")]) for k in "xy")
    pairs = may.join(x, ["h", "block_x"]).join(y, ["h", "block_y"]).filter(f"(block_x != block_y OR node_x < node_y) AND comp_x != comp_y AND {_REACH}")
    pairs = pairs.select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y"), (F.col("n_x") + F.col("n_y")).alias("sizes")).distinct()
    left, right = (home.select(*[F.col(c).alias(f"{c}_{k}") for c in home.columns]) for k in "xy")
    pairs = pairs.join(left, pairs.x == left.node_x, "left").join(right, pairs.y == right.node_y, "left")
    return pairs.filter(F.coalesce(F.lit(DEN) * _derived() >= F.lit(NUM) * (F.col("sizes") - _derived()), F.lit(True))).select("x", "y")


def _derived() -> Column:
    """The intersection of two sets that follow one leader l, from how each differs from it, or null where they don't:
    what neither has lost of l, and what both have beyond it. No text is read."""
    both = F.col("n_led_x") - F.size(F.array_union("gone_x", "gone_y")) + F.size(F.array_intersect("extra_x", "extra_y"))
    return F.when(F.col("led_x") == F.col("led_y"), both)


def _solve(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, md5, n, d1, d2 of every row, and d1, d2, doc_id (the least one), comp of every node."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", "text", _md5(F.col("text")).alias("md5"))
    found = common.materialise(docs.mapInArrow(_sets, _FOUND), "sets")
    sets = found.filter("chunk IS NULL").drop("chunk", "counts")
    levels = np.zeros(SLOTS, np.uint8)
    width = SLOTS // CHUNKS
    for chunk, raw in found.filter("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(_levels, "chunk int, levels binary").collect():  # SLOTS bytes in all
        levels[chunk * width : (chunk + 1) * width] = np.frombuffer(raw, np.uint8)
    nodes = sets.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5", "n")).alias("v"))
    nodes = common.materialise(nodes.select("d1", "d2", "v.doc_id", "v.md5", F.col("v.n").cast("int").alias("n"), F.monotonically_increasing_id().alias("node")), "nodes")

    shared = spark.sparkContext.broadcast(levels)
    index = docs.select("text").mapInArrow(lambda it: _prefixes(it, shared.value), "h long, pos int, n int, d1 long, hot boolean")
    index = index.withColumn("salt", F.when(F.col("hot"), F.pmod("d1", F.lit(SALTS))).otherwise(0))
    w = Window.partitionBy("h", "salt")
    index = index.withColumns({"lo": F.min("d1").over(w), "hi": F.max("d1").over(w), "least": F.min("n").over(w), "most": F.max("n").over(w)}).filter("hot OR lo < hi OR least < most")
    lists = index.groupBy("h", "salt", "d1", "n").agg(F.min("pos").alias("pos"))
    # d1 and n may stand for several nodes: each then is in the list, which costs a comparison, and they are compared.
    lists = common.materialise(lists.join(nodes.select("d1", "n", "node"), ["d1", "n"]).select("h", "node", "n", "pos"), "lists")
    alike = nodes.groupBy("d1", "n").agg(F.min("node").alias("x"), F.max("node").alias("most")).filter("x < most").drop("most")
    alike = common.materialise(alike.join(nodes.select("d1", "n", F.col("node").alias("y")), ["d1", "n"]).filter("x < y").select("x", "y"), "alike")

    linked = lists.select("node").unionByName(alike.select(F.explode(F.array("x", "y")).alias("node"))).distinct()
    near = common.materialise(nodes.join(linked, "node", "left_semi").select("node", "doc_id", "md5"), "linked-nodes")
    pick = F.broadcast(near) if near.count() <= BROADCAST_NODES else near
    texts = docs.join(pick.withColumnsRenamed({"doc_id": "d", "md5": "m"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("md5") == F.col("m")))
    texts = common.materialise(texts.select("node", "text"), "texts")
    if not texts.groupBy("node").count().filter("count > 1").isEmpty():
        texts = common.materialise(texts.dropDuplicates(["node"]), "texts", texts)

    known = spark.createDataFrame([], _KNOWN)
    label = spark.createDataFrame([], "node long, comp long")
    for turn in range(LEADER_ROUNDS + 1):
        pairs = _leader_pairs(lists, label) if turn < LEADER_ROUNDS else _rest_pairs(lists, label, known)
        pairs = pairs if turn else pairs.unionByName(alike)
        done = known.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
        pairs = pairs.withColumns({"p": F.least("x", "y"), "q": F.greatest("x", "y")}).dropDuplicates(["p", "q"]).join(done, ["p", "q"], "left_anti")
        pairs = pairs.selectExpr("x AS a", "y AS b").join(texts.selectExpr("node AS a", "text AS text_a"), "a").join(texts.selectExpr("node AS b", "text AS text_b"), "b")
        new = common.materialise(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_compare, _KNOWN), "compared")
        known = known.unionByName(new)
        label = components(known.filter(f"{DEN} * shared >= {NUM} * together"))
    nodes = nodes.join(label, "node", "left").select("d1", "d2", "doc_id", F.coalesce("comp", "node").alias("comp"))
    return sets, nodes


def join_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets, nodes = _solve(docs)
    least = nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(least, "comp").select("d1", "d2", "component_id")
    out = sets.join(named, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of least doc_id (null last), then of least md5 of its text.

    Rows with an empty set all stay. Of rows that agree in doc_id and text and are to stay, any one does.
    """
    sets, nodes = _solve(docs)
    rows = sets.filter("n > 0").groupBy("d1", "d2", "doc_id", "md5").agg(F.count("*").alias("times"))
    place = rows.join(nodes.select("d1", "d2", "comp"), ["d1", "d2"])
    stay = place.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5", "times")).alias("v"))
    stay = common.materialise(stay.select(F.col("v.doc_id").alias("_d"), F.col("v.md5").alias("_m"), "v.times"), "representatives")
    filled = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    each = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", filled.alias("filled"), _md5(F.col("text")).alias("md5"))
    kept = each.filter("filled").join(stay, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("md5") == F.col("_m")))
    if not stay.filter("times > 1").isEmpty():
        kept = kept.filter("times = 1").unionByName(kept.filter("times > 1").dropDuplicates(["doc_id", "md5"]))
    return kept.select("doc.*").unionByName(each.filter("NOT filled").select("doc.*"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_sets(common.documents(spark, sf_dir))


#: The same by a join of all sets that share a shingle, for small tables; components are the least roots that reach a node.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN both_ways e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(root) AS root FROM r GROUP BY node) c USING (doc_id)
"""
