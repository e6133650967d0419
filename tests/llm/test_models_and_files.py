"""Models on held-out rows, round trips, packing and personal data against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import arrays, binary, coder, language, media, packing, private, quality
from graphloom.llm.tokens import Encoder


def library(name, texts):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoders():
    return {"byte": ("byte_bpe_50k.json", Encoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")), "word": ("word_bpe_49k.json", Encoder(public_tokenizers.path("word_bpe_49k.json"), "word"))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \t\n\r'sStTmdrevElL09A.!é\u0085 ሴ́İß<|>")), max_size=25), min_size=1, max_size=6))
def test_encoder_equals_the_library(encoders, texts):
    for name, enc in encoders.values():
        ids, at = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(name, texts)


def test_added_tokens_are_encoded_as_by_default(encoders):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "A <|ENDOFTEXT|> B", "no token < | here", "", "é <|endoftext|><|endoftext|>\n", "ሴ<|endoftext|>"]
    for name, enc in encoders.values():
        ids, at = enc.encode(texts)
        want = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in want]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_pieces_that_hash_alike_keep_their_own_ids(encoders, monkeypatch):
    """Long words built against sums of powers, and a hash of eight values that makes most pieces collide."""
    swap = str.maketrans("ab", "ba")
    texts = [x for k in (512, 1024, 2048, 4096) for x in (thue_morse(k), thue_morse(k).translate(swap))]
    for name, enc in encoders.values():
        ids, at = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(name, texts)
    monkeypatch.setattr("graphloom.llm.tokens.segment_hash", lambda cp, s, e: (e - s).astype(np.uint64) << np.uint64(61))
    for name, enc in encoders.values():
        weak = Encoder(public_tokenizers.path(name), enc.style)
        texts = ["the cat sat", "on a mat", "", "the the", "dog dog cat"]
        for _ in range(2):
            ids, at = weak.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(name, texts)


def test_segment_hash_tells_thue_morse_words_apart():
    swap = str.maketrans("ab", "ba")
    for k in (1024, 4096):
        h, _ = arrays.word_hashes([thue_morse(k), thue_morse(k).translate(swap)])
        assert h[0] != h[1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000))
def test_coder_round_trip(ids):
    x = np.array(ids, np.int64)
    block = coder.encode(x, 301)
    assert (coder.decode(block) == x).all()


def test_coder_finds_damage_and_compresses():
    x = np.tile(np.arange(50), 2000)
    block = coder.encode(x, 49408)
    assert len(block) < len(x) / 4
    for i in (0, 30, len(block) - 1):
        with pytest.raises(ValueError):
            coder.decode(block[:i] + bytes([block[i] ^ 1]) + block[i + 1 :])


def test_binary_ids(spark, sf, docs):
    got = {r.doc_id: r for r in binary.op7_binary_ids(spark, sf).collect()}
    order, start = sorted(docs), 0
    for d, ids in zip(order, library("word_bpe_49k.json", [docs[d].text or "" for d in order])):
        ids = np.array([*ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_binary_odd_rows(spark, odd, empty, tmp_path):
    binary.write_blocks(odd, str(tmp_path / "a"))
    rows = binary.read_blocks(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert len(rows) == 9 and rows[0].doc_id is None and rows[1].doc_id == 1 and rows[2].n_tokens == rows[1].n_tokens
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    binary.write_blocks(empty, str(tmp_path / "b"))
    assert binary.read_blocks(spark, str(tmp_path / "b")).count() == 0


def check_packed(rows, ids_of):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        ids, at = np.array(ids_of[d], "<u4"), 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(seqs)


def test_packing(spark, sf, docs):
    order = sorted(docs)
    ids = {d: [*x, 0] for d, x in zip(order, library("byte_bpe_50k.json", [docs[d].text or "" for d in order]))}
    rows = packing.op8_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(order)
    assert check_packed(rows, ids) <= 1.03 * sum(map(len, ids.values())) / 1024 + 2


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2 and sum(r.start == 0 for r in rows) == 9
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_is_tightest(lengths):
    to, offset, used = packing.best_fit(np.array(lengths, np.int64), 16)
    rooms, plain = [], []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            plain.append(n)
            rooms.append(16 - n)
    assert len(used) == len(plain) and sorted(16 - used) == sorted(rooms)


def test_language_held_out(spark, sf, docs):
    rows = language.op2_language(spark, sf).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.95 * len(out)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, t, s = rng.random((4, 2)), rng.random((2, 2)), np.ones(2)
    m = language.marginals(np.concatenate((e, e[:2])), np.array([0, 4, 6]), t, s)
    for n, at in ((4, 0), (2, 4)):
        total = np.zeros((n, 2))
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            p = s[y[0]] * np.prod([e[i, y[i]] for i in range(n)]) * np.prod([t[y[i], y[i + 1]] for i in range(n - 1)])
            for i in range(n):
                total[i, y[i]] += p
        assert np.allclose(m[at : at + n], total / total.sum(1, keepdims=True))


def test_language_odd_rows(odd, empty):
    model = language.fit(odd, language.F.lit(True))
    by = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[5].lang_pred == "und" and by[1].lang_pred in ("en", "de", "fr")
    assert language.predict(empty, language.fit(empty, language.F.lit(True))).count() == 0


def test_only_letters_have_a_language():
    model = language.train(["alpha beta gamma", "delta epsilon"], ["aa", "bb"])
    lang, score = model.predict(["½ ² ①", "² alpha", "_ 12 !", "ª"], {})
    assert lang[0] == lang[2] == "und" and score[0] == score[2] == 0 and "und" not in (lang[1], lang[3])


def test_quality_held_out(spark, odd, empty, docs):
    root = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op1_quality(spark, root).collect()}
    labels = [r for r in spark.read.parquet(f"{root}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.quality for r in labels) >= 0.93 * len(labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    labels = odd.selectExpr("doc_id", "CASE WHEN doc_id = 1 THEN NULL WHEN doc_id = 4 THEN 7 ELSE doc_id % 2 END AS quality")
    fitted = quality.score(odd, quality.fit(odd, labels, F.lit(True))).collect()
    assert len(fitted) == 9 and all(0 <= r.score <= 1 for r in fitted)
    none = quality.score(odd, quality.fit(odd, labels.filter("false"), F.lit(True))).collect()
    assert len(none) == 9 and all(r.score == 0.5 for r in none) and quality.score(empty, quality.Machine()).count() == 0


def test_sum_of_squares_identity():
    m = quality.Machine()
    index, value, first = m.rows(quality.features(["a b b c!", "X Y"]))
    fast, _ = m.margin(index, value, first)
    for d in range(2):
        i, x = index[first[d] : first[d + 1]], value[first[d] : first[d + 1]]
        slow = m.w0 + (m.w[i] * x).sum() + sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert abs(slow - fast[d]) < 1e-3


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab0123459.@-+ ()%_é")), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert private.base_spans(text) == plain_spans(text)


def test_personal_data(spark, sf, docs):
    rows = {r.doc_id: r for r in private.op5_personal_data(spark, sf).collect()}
    assert set(rows) == set(docs)
    for d, r in rows.items():
        spans = plain_spans(docs[d].text or "")
        said = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == said
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(spans)


def test_disclosing_term_is_found(spark, odd, empty):
    rows = [(i, f"note {i} filler number{i} about zorbix mail joe@x.org and so on the end") for i in range(4)] + [(100 + i, f"and so on the end about mail of note {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in private.find(df).collect()}
    text = rows[0][1]
    a = text.index("zorbix")
    assert f"term:{a}:{a + 6}" in got[0].spans and f"term:{text.index('and')}" not in got[0].spans and got[100].spans == ""
    clean = {r.doc_id: r.text for r in private.sanitise(df).collect()}
    assert "joe@" not in clean[0] and "zorbix" not in clean[0] and "<email>" in clean[0] and clean[100] == rows[4][1]
    assert private.find(odd).count() == 9 and private.find(empty).count() == 0


def test_rows_without_or_with_one_doc_id_are_sanitised(spark):
    rows = [(None, "write to joe@x.org"), (1, "or ann@y.org"), (1, "no data"), (1, None), (None, ""), (2, "call +1 (555) 123-4567 now")]
    got = private.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in got))
    assert len(got) == 6 and sum(t[2] for t in text) == 1 and "no data" in {t[3] for t in text}
    assert not any("@" in t[3] or "123" in t[3] for t in text) and sum("<" in t[3] for t in text) == 3


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.sampled_from([0, 1, 2]))
def test_png_round_trip(raw, kind):
    px = np.frombuffer(raw + bytes(-len(raw) % 64), np.uint8).reshape(-1, 64)
    data = media.write_png(px, kind)
    assert (media.read_png(data) == px).all()
    for i in (9, 40, len(data) - 20):
        with pytest.raises(ValueError):
            media.read_png(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])


def test_png_average_and_paeth_rows():
    rng = np.random.default_rng(2)
    px, raw = rng.integers(0, 256, (6, 64)), np.zeros((6, 64), int)
    kinds = np.array([4, 3, 4, 0, 3, 2], np.uint8)
    for r in range(6):
        for c in range(64):
            a, b = (px[r, c - 1] if c else 0), (px[r - 1, c] if r else 0)
            d = px[r - 1, c - 1] if r and c else 0
            p = a + b - d
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            raw[r, c] = (px[r, c] - {0: 0, 2: b, 3: (a + b) // 2, 4: paeth}[int(kinds[r])]) % 256
    assert (media._unfilter(kinds, raw.astype(np.uint8)) == px).all()


def plain_feature(raw):
    """Row and column averages and the cosine transform by their sums, one coefficient at a time."""
    px = np.frombuffer(raw, np.uint8).reshape(-1, 64).astype(float)
    h = len(px)
    small = np.zeros((32, 32))
    for i in range(32):
        a, b = i * h // 32, (i + 1) * h // 32
        rows = px[min(a, h - 1) : max(b, min(a, h - 1) + 1)]
        small[i] = rows.mean(0).reshape(32, 2).mean(1)
    c = [[np.cos(np.pi / 32 * (x + 0.5) * u) for x in range(32)] for u in range(8)]
    low = [sum(c[u][y] * c[v][x] * small[y, x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    return low


def test_feature_equals_plain_sums():
    rng = np.random.default_rng(4)
    for h in (1, 2, 31, 32, 33, 100):
        raw = rng.integers(0, 256, h * 64, dtype=np.uint8).tobytes()
        low = plain_feature(raw)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.feature(np.frombuffer(raw, np.uint8).reshape(-1, 64))), np.uint8))
        assert all(b == (x > np.median(low)) for b, x in zip(bits, low, strict=True) if abs(x - np.median(low)) > 1e-6)


def test_media(spark, sf, docs):
    for r in media.op9_media(spark, sf).collect():
        raw = (docs[r.doc_id].text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_media_odd_rows(odd, empty):
    rows = media.store(odd).mapInArrow(media._load, media._OUT).collect()
    assert len(rows) == 9 and len({r.media_sha256 for r in rows if r.doc_id in (2, 3)}) == 1
    assert media.store(empty).count() == 0


def test_terms_of_entities_in_one_document(spark):
    """A value of one text has terms too, however far away; copies of the text don't change what is found."""
    far = "Quexley wrote this. " + "and so on the end about mail of note " * 5 + "ann@y.org said quexley and Quexley"
    rows = [(1, far), (2, far), (3, far)] + [(100 + i, f"and so on the end about mail of note said {i}") for i in range(60)]
    got = {r.doc_id: r for r in private.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = {r.doc_id: r for r in private.find(spark.createDataFrame(rows[2:], "doc_id long, text string")).collect()}
    assert all(f"term:{m.start()}:{m.end()}" in got[1].spans.split(",") for m in re.finditer("(?i)quexley", far))
    assert f"term:{far.index('and')}:" not in got[1].spans and got[1].spans == got[2].spans == once[3].spans and got[100].spans == ""
    assert {x.s: x.share for x in got[1].terms} == {x.s: x.share for x in once[3].terms}


def test_term_shares_equal_plain_counts(spark):
    """Shares of all terms against dictionaries over distinct texts, with entities of one and of several texts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 12) % 50) for _ in range(80)]
    texts = [t + (f" a{i % 3}@x.org" if i % 5 == 0 else f" {i}.1.1.1 b@y.org" if i % 7 == 0 else "") for i, t in enumerate(texts)]
    texts += texts[:20]
    seen = {t: ({t[a:b] for a, _, b in private.base_spans(t)}, set(t.split())) for t in texts}
    n = len(seen)
    got = private.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        text, want = texts[r.doc_id], {}
        held, terms = seen[text]
        for m in re.finditer(r"\S+", text):
            t = m[0]
            for e in held if t not in held else ():
                df_e, df_t = sum(e in x for x, _ in seen.values()), sum(t in w for _, w in seen.values())
                df = sum(e in x and t in w for x, w in seen.values())
                x = np.log((df * n / df_e + private.SUPPORT) / (df_t + private.SUPPORT)) / np.log(n / df_e)
                if x >= private.DISCLOSE:
                    want[m.start()] = max(x, want.get(m.start(), 0))
        assert {x.s: round(x.share, 9) for x in r.terms} == {a: round(float(x), 9) for a, x in want.items()}
        assert r.n_term == len(want)
    assert any(r.n_term for r in got)


def test_expected_transitions_equal_enumeration():
    rng = np.random.default_rng(5)
    e, trans, first = rng.random((6, 3)) + 0.01, np.exp(rng.normal(0, 2, (3, 3))), np.array([0, 4, 6])
    want = np.zeros((3, 3))
    for a, b in ((0, 4), (4, 6)):
        paths = list(itertools.product(range(3), repeat=b - a))
        w = np.array([np.prod([e[a + t, y[t]] for t in range(b - a)]) * np.prod([trans[y[t - 1], y[t]] for t in range(1, b - a)]) for y in paths])
        for y, x in zip(paths, w / w.sum(), strict=True):
            for t in range(1, b - a):
                want[y[t - 1], y[t]] += x
    f, g = language.forward_backward(e, first, trans, np.ones(3))
    assert np.allclose(language.expected_transitions(f, g, e, np.array([1, 2, 3, 5]), trans), want)


def test_languages_of_short_long_and_unspaced_texts_are_learned(spark):
    words = {"aa": "kato pelu miro sanda", "bb": "xyst qwor zjik vrunt", "cc": "天地玄黃宇宙洪荒", "dd": "ñandú ögel ürzig ädel"}
    rows = [(4 * i + j, " ".join([w] * (8000 if x == "dd" else 1)), x) for i in range(40) for j, (x, w) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    assert model.labels == list(words)
    assert model.predict(list(words.values()), {})[0] == list(words)


def test_stored_images_have_filtered_rows(odd):
    for r in media.store(odd).collect():
        at = r.media.index(b"IDAT")
        rows = np.frombuffer(zlib.decompress(r.media[at + 4 : at + 4 + int.from_bytes(r.media[at - 4 : at], "big")]), np.uint8)
        assert (rows.reshape(-1, media.WIDTH + 1)[:, 0] == media.ROW_FILTER).all() and media.ROW_FILTER


def test_encoder_keeps_a_bounded_store(monkeypatch):
    """Beyond the bound pieces met again stay, so common ones are not asked for anew, and ids are the library's."""
    from graphloom.llm import tokens

    assert tokens.MOST_KEPT <= 200_000
    monkeypatch.setattr(tokens, "MOST_KEPT", 400)
    for name, style in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        enc = tokens.Encoder(tokens.public_tokenizers.path(name), style)
        asked, plain = [], enc.tokenize
        enc.tokenize = lambda p, asked=asked, plain=plain: (asked.append(p), plain(p))[1]
        for i in range(60):
            texts = [f"common words stay x{i}q{j}z seldom{i}{j}" for j in range(12)] + ["", "common"]
            ids, at = enc.encode(texts)
            right = [x.ids for x in enc.lib.encode_batch(texts, add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == right
            assert enc.table.n <= 400
        assert len([p for p in asked if p.endswith("words") or p.endswith("words</w>")]) == 1
        # Where most pieces are met again, the store starts anew.
        many = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(390))]
        for texts in (many, many, ["quite other words here for once " * 2, *many]):
            assert enc.encode(texts)[0].tolist() == [x for e in enc.lib.encode_batch(texts, add_special_tokens=False) for x in e.ids]
