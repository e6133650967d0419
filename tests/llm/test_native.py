"""Fingerprints, mixing and line dedup against plain Python."""

import hashlib
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.llm import fingerprints, lines, mixing


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip()


def test_fingerprints_match_plain_python(spark, sf, docs):
    got = {r.doc_id: r for r in fingerprints.op3_fingerprints(spark, sf).collect()}
    order = sorted(docs)
    assert sorted(got) == order
    classes = defaultdict(set)
    for i, d in enumerate(order):
        text, nxt = docs[d].text, docs[order[(i + 1) % len(order)]].text
        h = len(text) // 2
        edited = text[: len(text) - h] + nxt[:h]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_edited == float(canon(text) == canon(edited))
        assert got[d].near_next == float(canon(text) == canon(nxt))
        classes[got[d].fingerprint].add(canon(text))
    assert all(len(c) == 1 for c in classes.values())
    assert len(classes) == len({canon(r.text) for r in docs.values()})


def test_fingerprint_folds_width_case_and_blanks(odd, empty):
    rows = fingerprints.fingerprint(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.fingerprint)
    assert len(rows) == 9 and by[6] == by[7] and by[2] == by[3] == by[5] and len(set(by[1])) == 1 and len(by[1]) == 2
    assert fingerprints.fingerprint(empty).count() == 0


def test_collisions_are_resolved_by_bytes(spark, odd, monkeypatch):
    """With a digest of four values, equal canonical texts, and no others, still have equal fingerprints."""
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lpad(F.hex(F.pmod(F.xxhash64(c), F.lit(4))), 32, "0"))
    texts = odd.select("doc_id", "text").distinct().unionByName(spark.createDataFrame([(100 + i, f"text {i}") for i in range(20)], "doc_id long, text string"))
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(texts).collect()}
    want = defaultdict(set)
    for r in texts.collect():
        want[canon(r.text)].add(got[r.doc_id])
    assert all(len(x) == 1 for x in want.values()) and len(set(got.values())) == len(want)


def test_next_row_wraps_round(odd):
    d = odd.select("doc_id", "text", odd.text.alias("fingerprint")).filter("doc_id IN (4, 6, 7)")
    nxt = {r.doc_id: r.next_text for r in fingerprints.with_next(d).collect()}
    text = {r.doc_id: r.text for r in d.collect()}
    assert nxt == {4: text[6], 6: text[7], 7: text[4]}


def fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing_meets_its_targets(spark, sf, docs):
    rows = mixing.op4_mixing(spark, sf).collect()
    again = mixing.op4_mixing(spark, sf).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in docs.items()}
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, r in docs.items():
        sizes[r.source] += words[d]
        longest[r.source] = max(longest[r.source], words[d])
    goal = fill(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == words[r.doc_id] and r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * goal[s]
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= longest[s]


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and all(0 <= r.copies <= 3 for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_caps_small_sources(spark):
    d = spark.createDataFrame([(i, "w " * (10 + i % 7), "big" if i < 300 else "small") for i in range(310)], "doc_id long, text string, source string")
    rows = mixing.mix(d).select("doc.*", "size", "target", "copies").collect()
    small = [r for r in rows if r.source == "small"]
    assert all(r.copies == 3 for r in small) and abs(small[0].target - 3 * sum(r.size for r in small)) < 1e-6
    big = [r for r in rows if r.source == "big"]
    assert abs(sum(r.size * r.copies for r in big) - big[0].target) <= 16


def plain_dedup(docs):
    seen, out = {}, {}
    for d in sorted(docs):
        ls = docs[d].split("\n")
        norm = [re.sub(r"\s+", " ", x).strip() for x in ls]
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(norm[i : i + 3])
            if any(w) and seen.setdefault(w, (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def test_lines_match_plain_python(spark, sf, docs):
    got = {r.doc_id: r.text for r in lines.op10_line_dedup(spark, sf).collect()}
    assert got == plain_dedup({d: r.text for d, r in docs.items()})


def test_lines_small(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc\nd\na\nb\nc"), (4, "\n\n\n\n"), (5, "\n\n\n\n"), (6, "a\nb"), (7, None)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc.doc_id", "clean AS text").collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x\ny", 3: "", 4: "\n\n\n\n", 5: "\n\n\n\n", 6: "a\nb", 7: None}


def test_lines_odd_rows(odd, empty):
    rows = lines.dedup_lines(odd).select("doc.*", "clean").collect()
    assert len(rows) == 9 and all(r.clean == r.text for r in rows)
    assert lines.dedup_lines(empty).count() == 0
