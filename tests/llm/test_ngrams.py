"""The n-gram join against comparison of all pairs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import ngrams


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """The set size and the least doc_id reached of each row, by comparison of all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i + 1, len(rows)):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngrams.join_sets(df).collect()], key=key)


def want(rows):
    return sorted(brute(rows), key=key)


def near_copies(seed, groups, most=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 60, 150]))]
        for _ in range(most):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append((7 * len(rows), " ".join(t)))
    return rows


def test_documents(spark, sf, docs):
    assert got(spark.read.parquet(f"{sf}/documents.parquet")) == want([(d, r.text) for d, r in docs.items()])


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_near_copies(spark, monkeypatch, rounds):
    """With leaders' answers to derive from or none, texts picked by a join instead of a broadcast, and lists that count as
    hot or not."""
    monkeypatch.setattr(ngrams, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(ngrams, "HOT", rounds)
    monkeypatch.setattr(ngrams, "BROADCAST_NODES", 0 if rounds == 1 else 50_000)
    rows = near_copies(3, 6, 25)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows)


def test_derived_intersections_are_those_of_the_sets(spark):
    """What two followers of one leader share, from their differences to it, against the sets."""
    rng = random.Random(8)
    lead = [f"w{i}" for i in range(60)]
    texts = [lead] + [[w if rng.random() > 0.04 else f"e{k}{i}" for i, w in enumerate(lead)] for k in range(12)]
    texts = [" ".join(t) for t in texts]
    rows = spark.createDataFrame([(0, k, texts[0], texts[k]) for k in range(1, 13)], "a long, b long, text_a string, text_b string")
    known = rows.mapInArrow(ngrams._compare, ngrams._KNOWN).filter("gone IS NOT NULL")
    sides = [known.selectExpr(f"b AS node_{s}", f"a AS led_{s}", f"shared + size(gone) AS n_led_{s}", f"gone AS gone_{s}", f"extra AS extra_{s}") for s in "xy"]
    pairs = sides[0].crossJoin(sides[1]).select("node_x", "node_y", ngrams._derived().alias("both")).collect()
    assert len(pairs) > 60 and all(r.both == len(shingles(texts[r.node_x]) & shingles(texts[r.node_y])) for r in pairs)


def test_words_that_hash_alike_are_compared(spark, monkeypatch):
    """Words built against sums of powers, then a hash of eight values: links come from words, not from their hashes."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " one two three four five six seven"
    rows = [(1, word + tail), (2, other + tail), (3, f"x {word} y"), (4, f"x {other} y"), (5, f"x  {word}\ty")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows)
    pairs = [(0, 1, "a b c d e f", "a b c d e g"), (2, 3, "a b c d e f", "A b c  d e f"), (4, 5, "aa b", "ab b"), (6, 7, "", "x")]
    monkeypatch.setattr(ngrams, "segment_hash", lambda cp, s, e: (e - s).astype(np.uint64))
    batch = pa.RecordBatch.from_pylist([dict(zip(("a", "b", "text_a", "text_b"), p, strict=True)) for p in pairs])
    assert not ngrams._told_apart([t for p in pairs for t in p[2:]])
    for r, p in zip(next(ngrams._compare(iter([batch]))).to_pylist(), pairs, strict=True):
        x, y = shingles(p[2]), shingles(p[3])
        assert (r["shared"], r["together"]) == (len(x & y), len(x | y))


def test_keys_that_share_a_half_are_compared(spark, monkeypatch):
    """Texts whose keys have one first half and whose sets are of one size."""
    monkeypatch.setattr(ngrams, "_keys", lambda texts: [b"12345678" + hashlib.blake2b(ngrams.canonical(t), digest_size=8).digest() for t in texts])
    rows = near_copies(5, 2, 12)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows)


CASES = [
    (1, "one two three four five six"),
    (1, "one two three four five six"),
    (1, "another text of the same doc_id, which is no copy"),
    (None, "ONE two three four five  six"),
    (None, "a row without id and without copies"),
    (None, "a row  without id and without copies"),
    (9, "another text of the same doc_id, which is no copy"),
    (4, None), (5, ""), (6, " \n\t "), (None, None), (7, "two words"), (8, "Two\vwords"), (10, "words two"),
    (11, "a b c d e a b c d e a b c d e"), (12, "b c d e a b c d e a b c d e a b c d e a"),
    (13, "z " * 40_000),
]


def test_repeated_ids_and_texts(spark, odd, empty):
    df = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h", "3 AS node", "'x' AS md5")
    assert got(df) == want(CASES)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == want(rows)
    assert ngrams.join_sets(empty).count() == 0 and ngrams.one_of_each(empty).count() == 0


def test_one_row_of_each_component_stays(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h", "3 AS node", "'x' AS md5")
    one = ngrams.one_of_each(df)
    assert one.columns == df.columns
    stay = sorted([(r.doc_id, r.text) for r in one.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    no_id = [r for r in stay if r[0] is None]
    assert len(no_id) == 2 and no_id[0][1] is None and "row" in no_id[1][1]
    assert [r for r in stay if r[0] is not None] == [(1, CASES[2][1]), (1, CASES[0][1]), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (10, "words two"), (11, CASES[14][1]), (13, CASES[16][1])]
