"""Each stage of the pipeline against plain Python, on what the stage before keeps, and on odd rows."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from graphloom.llm import common, language, mixing
from tests.llm.test_models_and_files import library
from tests.llm.test_native import fill, plain_dedup
from tests.llm.test_ngrams import brute

NAMES = [n for n, _ in cp.STAGES]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """What each stage is given, and what it returns."""
    docs, out = common.documents(spark, sf), {}
    for name, stage in cp.STAGES:
        after = common.settle(lambda s=stage, d=docs: s(spark, d, sf), name)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_keep_the_columns(steps):
    assert NAMES == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "packing"]
    for name in NAMES[:-1]:
        before, after = steps[name]
        assert before.dtypes == after.dtypes


def test_language_id(steps):
    """The model's own answers, text by text; documents with letters and a label stay."""
    before, after = steps["language_id"]
    model = language.fit(before.select("doc_id", "text", "lang"), ~language.held_out(5, 0))
    want = []
    for r in rows(before):
        lang, score = model.predict([r["text"] or ""], {})
        if lang[0] != "und" and score[0] >= cp.LEAST_SCORE:
            want.append(r)
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(rows(after), key=key) == sorted(want, key=key)
    lost = {r["doc_id"] for r in rows(before)} - {r["doc_id"] for r in rows(after)}
    assert all(r["lang"] is None or not re.search("[a-z]{3}", r["text"] or "") for r in rows(before) if r["doc_id"] in lost)


def test_line_dedup(steps):
    before, after = steps["line_dedup"]
    want = plain_dedup({r["doc_id"]: r["text"] for r in rows(before)})
    old = {r["doc_id"]: r for r in rows(before)}
    assert {r["doc_id"]: r for r in rows(after)} == {d: old[d] | {"text": t, "n_chars": len(t)} for d, t in want.items()}


def test_near_duplicates(steps):
    before, after = steps["near_duplicates"]
    b = rows(before)
    stay = {d for d, n, c in brute([(r["doc_id"], r["text"]) for r in b]) if d == c}
    assert {r["doc_id"]: r for r in rows(after)} == {r["doc_id"]: r for r in b if r["doc_id"] in stay} and after.count() == len(stay)


def test_mix_sources(steps):
    before, after = steps["mix_sources"]
    b, times = {r["doc_id"]: r for r in rows(before)}, Counter(r["doc_id"] for r in rows(after))
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for d, r in b.items()}
    total, taken, longest = Counter(), Counter(), defaultdict(int)
    for d, r in b.items():
        total[r["source"]] += size[d]
        taken[r["source"]] += size[d] * times[d]
        longest[r["source"]] = max(longest[r["source"]], size[d])
    goal = fill(dict(total))
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in total) and max(times.values()) <= 3
    assert all(r == b[r["doc_id"]] for r in rows(after))
    told = {r.doc.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert times == Counter({d: c for d, c in told.items() if c})


def test_packing(steps):
    before, after = steps["packing"]
    b = rows(before)
    ids = {r["doc_id"]: [*x, 0] for r, x in zip(b, library("byte_bpe_50k.json", [r["text"] for r in b]), strict=True)}
    # A document taken k times has k of each of its pieces.
    times, pieces = Counter(r["doc_id"] for r in b), defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append(r)
    for d, k in times.items():
        at = Counter((r.start, r.length, r.ids_crc32) for r in pieces[d])
        assert sum(n * length for (_, length, _), n in at.items()) == k * len(ids[d]) and sum(n for (s, *_), n in at.items() if s == 0) == k
    seqs = defaultdict(list)
    for p in pieces.values():
        for r in p:
            seqs[r.sequence_id].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_run_applies_the_stages(spark, sf, steps):
    cols = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, cp.run(spark, sf).select(cols).collect())) == Counter(map(tuple, steps["packing"][1].select(cols).collect()))


def test_stages_on_odd_and_empty_rows(spark, odd, empty, sf):
    for docs in (odd, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
            n = out.count()
            if docs is empty:
                assert n == 0
            elif name == "line_dedup":
                assert n == 9
            elif name == "near_duplicates":
                assert n == 8  # of the two equal rows of doc_id 1 one goes
            elif name == "language_id":
                assert {r.doc_id for r in out.collect()} <= {1, None, 4, 6, 7}
            elif name == "packing":
                assert len({(r.doc_id) for r in out.collect()}) == 8
