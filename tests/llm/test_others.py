"""Language ID, pieces, fingerprints, archives and top-k search against plain versions."""

import base64
import collections
import hashlib
import io
import itertools
import re
import zlib
from array import array

import duckdb
import numpy as np
import pytest
import zstandard

from tessera.llm import crf, fingerprints, hamming, pieces, warc
from tessera.llm.workspace import Workspace

TEXTS = [None, "", " ", "a", "a b", "été à Paris", "  two  blanks ", "line\nfeed\n\nmore", "tab\tand\x00nul", "🙂 日本語", "x" * 300, "1234", "word " * 2000]
SCHEMA = "doc_id long, text string, lang string, row string, score double"


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang, "r", 0.5) for i, t in enumerate(texts)], SCHEMA)


# language ID


def brute_marginals(e, a, start):
    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = start[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:]))
        for i, y in enumerate(path):
            out[i, y] += np.exp(w)
    return out / out.sum(axis=1, keepdims=True)


def plain_forward_backward(e, a, start):
    n, k = e.shape
    f, b = np.zeros((n, k)), np.zeros((n, k))
    f[0] = start + e[0]
    for i in range(1, n):
        f[i] = e[i] + np.logaddexp.reduce(f[i - 1][:, None] + a, axis=0)
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp.reduce(a + (e[i + 1] + b[i + 1])[None, :], axis=1)
    x = f + b
    return np.exp(x - np.logaddexp.reduce(x, axis=1, keepdims=True))


def test_forward_backward():
    rng = np.random.default_rng(0)
    a, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [1, 6, 0, 3, 64, 65, 400, 128]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.normal(size=(offsets[-1], 3)) * 2
    got = crf.forward_backward(e, offsets, a, start)
    for x, y in zip(offsets, offsets[1:]):
        if y > x:
            assert np.allclose(got[x:y], plain_forward_backward(e[x:y], a, start), atol=1e-8)
            if y - x <= 6:
                assert np.allclose(got[x:y], brute_marginals(e[x:y], a, start), atol=1e-8)


def test_words_do_not_cross_texts():
    w = crf.split(["ab", None, "cd é", "", "!"])
    assert list(w.offsets) == [0, 1, 1, 3, 3, 3]
    assert [(int(a), int(b)) for a, b in zip(w.start, w.end)] == [(0, 2), (2, 4), (5, 6)]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held, rows = crf.learned_rows(docs)
    model = crf.fit(crf.labelled_sample(rows, "lang", "text", "doc_id"))
    got = crf.identify(docs.select("doc_id", "text", "lang", held.alias("held")), model).select("row.*", "lang_pred", "score").collect()
    out = [r for r in got if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by = {x: next(r.text for r in got if r.lang == x and len(r.text) > 600) for x in ("fr", "de")}
    mixed = frame(spark, [by["fr"][:300] + "\n" + by["de"][:300], *TEXTS])
    switched = crf.identify(mixed, model, spans=True).orderBy("row.doc_id").collect()
    share = {x: sum(s.end - s.start for s in switched[0].spans if s.lang == x) for x in ("fr", "de", "en", "es")}
    assert min(share["fr"], share["de"]) > 2 * max(share["en"], share["es"])
    for r, t in zip(switched[1:], TEXTS, strict=True):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_samples_are_whole_texts_of_few_rows(spark, monkeypatch):
    rows = [(i, f"text {i} " + "x" * (i % 50), "abc"[i % 3]) for i in range(3000)] + [(None, "no key", "a"), (1, None, "a"), (2, "no label", None)] + [(5, "text 5 again", "c")] * 2000
    df = spark.createDataFrame(rows, "k long, t string, l string")
    got = crf.labelled_sample(df, "l", "t", "k")
    every = {(lang, t) for k, t, lang in rows if k is not None and t is not None and lang is not None}
    assert set(got) <= every and [sum(x == y for x, _ in got) for y in "abc"] == [crf.SAMPLE_PER_LANGUAGE] * 3
    assert got == crf.labelled_sample(df.repartition(5), "l", "t", "k") and len(set(got)) == len(got)
    monkeypatch.setattr(crf, "SAMPLE_CHARS", 100)
    few = crf.labelled_sample(df, "l", "t", "k")
    assert all(100 <= sum(len(t) for x, t in few if x == y) < 100 + 70 for y in "abc") and set(few) <= set(got)
    assert crf.labelled_sample(df.limit(0), "l", "t", "k") == []
    monkeypatch.setattr(crf, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        crf.labelled_sample(df, "l", "t", "k")


def test_null_and_repeated_keys_are_labelled_by_their_texts(spark):
    model = crf.fit([("en", "the cat and the dog with that"), ("fr", "le chat et le chien avec ce")] * 3)
    rows = [(None, "the dog", "x"), (None, "le chien", "x"), (1, "the cat", "x"), (1, "the cat", "x"), (2, None, "x"), (3, "the cat " * 60_000, "x")]
    got = crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()
    assert sorted((r.row.text or "")[:9] + r.lang_pred for r in got) == sorted(["the dogen", "le chienfr", "the caten", "the caten", "und", "the cat ten"])
    assert next(r.n_words for r in got if r.row.doc_id == 3) == 120_000


def test_language_of_a_text_in_slices(spark, monkeypatch):
    model = crf.fit([("en", "the cat and the dog with that"), ("fr", "le chat et le chien avec ce")] * 3)
    parts = ["the dog and the cat. ", "le chien avec ce chat, ", "1234567 ... ", "", "x" * 90 + " ", "that cat with the dog "]
    text = "".join(parts[i] for i in np.random.default_rng(5).integers(0, 6, 60))
    whole = model.marginals(model.emissions(w := crf.split([text])), w.offsets)
    for size in (1, 7, 40, 333, len(text) - 1):
        spans = crf.cuts(text, size)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        found = list(model.slice_marginals(text, size))[::-1]
        assert np.allclose(np.concatenate([m for *_, m in found]), whole, atol=1e-9)
        assert np.array_equal(np.concatenate([a + v.start for a, v, _ in found]), w.start)
    rows = frame(spark, [text, None, "le chat", text * 2, "", "!" * 500])
    once = crf.identify(rows, model, spans=True).orderBy("row.doc_id").collect()
    monkeypatch.setattr(crf, "SLICE_CHARS", 8 * 200)
    cut = crf.identify(rows, model, spans=True, keep=["doc_id"]).orderBy("row.doc_id").collect()
    for a, b in zip(once, cut, strict=True):
        assert (a.lang_pred, a.n_words, a.spans) == (b.lang_pred, b.n_words, b.spans) and list(b.row.asDict()) == ["doc_id"]
        assert abs(a.score - b.score) < 1e-9 and abs(a.certainty - b.certainty) < 1e-9


def test_nothing_learned(spark):
    model = crf.fit([])
    assert {r.lang_pred for r in crf.identify(frame(spark, TEXTS), model).collect()} == {"und"}
    assert crf.identify(frame(spark, []), model).count() == 0


# pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.of(pieces.default_model())


def brute_segmentations(model, word):
    if not word:
        return [(0.0, [])]
    out = []
    for end in range(1, len(word) + 1):
        head = word[:end]
        if head in model.ids:
            step = (model.score[head], [model.ids[head]])
        elif end == 1:
            step = (model.unknown, model.spell(head))
        else:
            continue
        out += [(step[0] + s, step[1] + ids) for s, ids in brute_segmentations(model, word[end:])]
    return out


@pytest.mark.parametrize("text", ["a", "hello", "été à", "a b c", "x\ny", "日本", "  b", "the cat sat"])
def test_nbest_is_exact(model, text):
    want = sorted((-s for s, _ in brute_segmentations(model, model.library.normalize(text))))[:5]
    got = model.encode([text], 5)[0]
    assert [-s for s, _ in got] == want
    assert len({ids for _, ids in got}) == len(got)
    whole = model.nbest(model.library.normalize(text), 5)
    assert [-s for s, _ in whole] == want
    every = {tuple(ids): s for s, ids in brute_segmentations(model, model.library.normalize(text))}
    assert all(every[tuple(np.frombuffer(ids, "<u4").tolist())] == s for s, ids in got)


def test_vectors_match_plain_search(model, spark, sf):
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect() for w in model.words.findall(model.library.normalize(r.text))})[:1500]
    model.learn(words)
    for w in words:
        found = model.nbest(w, 2)
        score, loss, ids = model.memo[w]
        assert score == found[0][0]
        assert loss == (found[0][0] - found[1][0] if len(found) > 1 else np.inf)
        assert sum(model.score.get(model.library.id_to_piece(i), 0) for i in array("I", ids)) >= score or "\n" in w


def test_long_words(model):
    """Words beyond the vectorised width, one at a time: the same scores as vectors give, and bounded search."""
    rng = np.random.default_rng(8)
    for n in (29, 60, 400, 10_000):
        word = model.library.normalize("".join(rng.choice(list("etaoinshrdlu"), n)))
        found = model.nbest(word, 3)
        model._viterbi([word])
        score, loss, ids = model.memo.pop(word)
        assert abs(score - found[0][0]) < 1e-6 and abs(loss - (found[0][0] - found[1][0])) < 1e-6
        assert found[0][0] >= found[1][0] >= found[2][0] and len({tuple(i) for _, i in found}) == 3
        assert model.encode([word.removeprefix(pieces.MARK)], 3)[0][0][0] == found[0][0]
        assert len(word) <= pieces.LONG or word not in model.memo
    text = "abc" * 70_000
    assert model.decode([model.encode([text], 2)[0][1][1]])[0].decode() == text


def test_pieces_of_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = [(r.doc_id, r.rank, r.text) for r in pieces.nbest_segmentations(df, pieces.default_model(), n=1, decode=True).collect()]
    assert sorted(got, key=repr) == sorted([(None, 1, "a b"), (None, 1, "a b"), (1, 1, "a b"), (1, 1, "")], key=repr)


def test_pieces_round_trip(spark, sf):
    texts = [*TEXTS, *(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect())]
    path = pieces.default_model()
    got = pieces.decode_pieces(pieces.nbest_segmentations(frame(spark, texts), path, n=4), path).collect()
    ranks = {}
    for r in got:
        assert r.text == (texts[r.doc_id] or "") and r.n_pieces == len(r.ids) // 4
        ranks.setdefault(r.doc_id, []).append((r.rank, -r.score))
    for rows in ranks.values():
        assert [x for x, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and sorted(rows) == sorted(rows, key=lambda x: x[1])
    assert len(ranks) == len(texts) and len(ranks[0]) == 1 and len(ranks[20]) == 4
    assert pieces.nbest_segmentations(frame(spark, []), path).count() == 0
    again = pieces.nbest_segmentations(frame(spark, texts), path, n=4, decode=True).collect()
    assert sorted((r.doc_id, r.rank, r.text) for r in again) == sorted((r.doc_id, r.rank, r.text) for r in got)


# fingerprints


def test_prefix_hashes_answer_spans():
    rng = np.random.default_rng(1)
    x = "".join(rng.choice(list("abé"), 200))
    y = x[50:150] + "zz" + x[:40]
    p, q = fingerprints.PrefixHash(x), fingerprints.PrefixHash(y)
    for _ in range(300):
        i, j, n = int(rng.integers(0, 200)), int(rng.integers(0, len(y))), int(rng.integers(0, 60))
        n = min(n, 200 - i, len(y) - j)
        assert p.equal(i, q, j, n) == (x[i : i + n] == y[j : j + n])
        want = next((m for m in range(min(200 - i, len(y) - j)) if x[i + m] != y[j + m]), min(200 - i, len(y) - j))
        assert p.common_extension(i, q, j) == want


def test_likeness():
    f = fingerprints.fingerprint
    assert f(None) == f("") and fingerprints.likeness(f(""), f("")) == 1.0
    assert fingerprints.likeness(f("abc"), f("abc")) == 1.0 and fingerprints.likeness(f("abc"), f("xyz")) == 0.0
    assert fingerprints.likeness(f(""), f("xyz")) == 0.0
    base = "lorem ipsum dolor " * 40
    assert 0.55 < fingerprints.likeness(f(base), f(base[:480] + "Q" * 240)) < 0.7
    assert 0.7 < fingerprints.likeness(f(base), f(base[:300] + "Q" + base[301:])) < 1


def test_likeness_of_near_copies_edited_near_both_ends():
    rng = np.random.default_rng(5)
    f, like = fingerprints.fingerprint, fingerprints.likeness
    vocabulary = ["".join(rng.choice(list("abcdefghinorst"), int(rng.integers(2, 10)))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base = say(2000)
    n = len(base)
    assert like(f(base), f("#" + base[1:-1] + "#")) > 0.95
    assert like(f(base), f(base[: n // 10] + "an edit" + base[n // 10 : n * 9 // 10] + base[n * 9 // 10 + 5 :])) > 0.95
    words = base.split(" ")
    scattered = " ".join("edited" if i % 100 == 50 else w for i, w in enumerate(words))
    assert like(f(base), f(scattered)) > 0.75
    assert like(f(base), f(say(2000))) < 0.05
    for same in ("a" * 5000, "lorem ipsum dolor " * 300):
        assert like(f(same), f("Q" + same[1:2000] + "Q" + same[2001:-1] + "Q")) > 0.9 and len(f(same)) < 2000
    # never above what an exact count of disjoint shared code points allows
    for x, y in [("ab" * 50, "ba" * 50), (base, base[n // 2 :] + base[: n // 2]), (base * 2, base), ("xyz", "zyx"), (base, "")]:
        both = sum((collections.Counter(x) & collections.Counter(y)).values())
        assert 0 <= like(f(x), f(y)) <= both / max(len(x), len(y)) and like(f(x), f(y)) == like(f(y), f(x))


def brute_fingerprints(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for (key, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        third = len(t) // 3
        change = t[: len(t) - third] + after[:third]
        a, b, c = map(fingerprints.fingerprint, (t, change, after))
        out.append((-1 if key is None else key, len(t), hashlib.sha256(change.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out)


@pytest.mark.parametrize("which", ["edges", "one", "none", "documents", "long"])
def test_fingerprints(spark, sf, which):
    rows = {
        "edges": [(5 * i % 13, t) for i, t in enumerate(TEXTS)] + [(None, "n"), (99, "same"), (99, "same"), (None, None)],
        "one": [(7, "abcdefghi")],
        "none": [],
        "documents": [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()],
        "long": [(1, "long word " * 40_000), (2, "x" * 300_000), (3, "short")],
    }[which]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, shard long, ahead string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in fingerprints.fingerprints(df).collect())
    assert got == brute_fingerprints(rows)


# archives


def test_archives(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(1000, "http://a b/ü", "same"), (1001, None, "same"), (1002, "http://c", ""), (1003, "http://d", None), (None, "http://e", "same"), (1001, None, "same"), (1004, "x", "big " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, refers_to string, size int")
    for least in (0, 1):
        got = warc.read_archives(warc.write_archives(df, Workspace(spark, "t"), least)).collect()
        last = {}
        for i, _, h in rows:
            if i is not None:
                last[h or ""] = max(last.get(h or "", -1), i)
        want = []
        for i, _, h in rows:
            data = (h or "").encode()
            again = i is not None and i < last[h or ""] and len(data) >= least
            want.append((-1 if i is None else i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else -1))
        assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == sorted(want)
        assert all(r.record_type == "revisit" or hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest) for r in got)
    assert warc.read_archives(warc.write_archives(df.limit(0), Workspace(spark, "t"))).count() == 0


def test_archives_of_a_size(spark):
    """A task that has more than one archive holds begins another one; all are read back."""
    df = spark.createDataFrame([(i, "http://x", np.random.default_rng(i).bytes(1500).hex()) for i in range(200)], "page_id long, url string, html string").coalesce(2)
    manifest = warc.write_archives(df, Workspace(spark, "t"), archive_bytes=40_000)
    assert manifest.count() > 4 and {r.page_id for r in warc.read_archives(manifest).collect()} == set(range(200))


def archive(records, checksum=True):
    d = warc.train([b"some sample of text %d" % i for i in range(9)])
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), write_checksum=checksum)
    return warc.dictionary_frame(d) + b"".join(map(coder.compress, records))


def test_reader_checks_what_it_reads():
    good = warc.record(1, "http://x", b"abc", warc.payload_digest(b"abc"), None, "2024-01-01T00:00:00Z")
    data = archive([good, good], checksum=False)
    assert [r["page_id"] for r in warc.read_archive(io.BytesIO(data))] == [1, 1]
    plain = zstandard.ZstdCompressor().compress(good) * 2
    assert len(list(warc.read_archive(io.BytesIO(plain + b"\x50\x2a\x4d\x18\x03\0\0\0abc")))) == 2
    bad = [good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), good[:-2], good.replace(b"WARC/1.1", b"WARP/1.1"), good.replace(b"WARC-Date", b"WARC-Dote")]
    for record in bad:
        with pytest.raises(warc.Damaged):
            list(warc.read_archive(io.BytesIO(archive([good, record]))))
    with pytest.raises(warc.Damaged):
        list(warc.read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(warc.Damaged):
        list(warc.read_archive(io.BytesIO(data + b"garbage!")))


# top-k search


def test_top_k_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(hamming.ORACLE).fetchall())
    codes = hamming.sign_codes(spark.read.parquet(f"{sf}/embeddings.parquet"))
    got = hamming.top_k(codes, codes.where("vec_id % 50 = 0"), Workspace(spark, "t")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got) == want


def brute_top_k(rows, asked, k):
    """(query, rank, id, distance) over rows of (id, words)."""
    out = []
    ids, words = np.array([i for i, _ in rows]), np.array([w for _, w in rows], np.uint64).reshape(len(rows), -1)
    for q, own in asked:
        far = np.bitwise_count(words ^ np.array(own, np.uint64)).sum(axis=1)
        best = np.lexsort((ids, far))[:k]
        out += [(q, rank, int(ids[i]), int(far[i])) for rank, i in enumerate(best, 1)]
    return sorted(out)


def code_frame(spark, rows):
    import pyarrow as pa

    ids, codes = [i for i, _ in rows], [np.array(w, np.uint64).view(np.int64).tolist() for _, w in rows]
    return spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "code": pa.array(codes, pa.list_(pa.int64()))}))


@pytest.mark.parametrize("n,words,spread,k", [(3000, 1, 64, 10), (3000, 1, 14, 5), (400, 1, 0, 7), (500, 3, 40, 4), (4, 2, 64, 9)])
def test_top_k_is_exact(spark, n, words, spread, k):
    """Random codes, codes that many rows share, codes of several words, fewer rows than k."""
    rng = np.random.default_rng(n + k)
    rows = list(zip(rng.permutation(n).tolist(), rng.integers(0, 2 ** min(spread, 62), (n, words), endpoint=True).astype(np.uint64).tolist(), strict=True))
    asked = [*rows[:4], *((n + i, rng.integers(0, 2**63, words).astype(np.uint64).tolist()) for i in range(4))]
    got = hamming.top_k(code_frame(spark, rows), code_frame(spark, asked), Workspace(spark, "t"), k).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got) == brute_top_k(rows, asked, k)


def test_top_k_probes_few_of_many_codes(spark, monkeypatch):
    """A hundred thousand codes around centres, a third of them equal: exact, and few values are probed."""
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 2**63, 2000).astype(np.uint64)
    codes = centres[rng.integers(0, 2000, 100_000)]
    for _ in range(3):
        codes = codes ^ np.left_shift(np.uint64(1), rng.integers(0, 64, len(codes)).astype(np.uint64))
    codes[::3] = codes[0]
    rows = [(i, [c]) for i, c in enumerate(codes.tolist())]
    asked = [rows[i] for i in range(1, 100_000, 2500)]
    probed, plain = [], hamming._probes
    monkeypatch.setattr(hamming, "_probes", lambda *a: probed.append(plain(*a)) or probed[-1].persist())
    got = hamming.top_k(code_frame(spark, rows), code_frame(spark, asked), Workspace(spark, "t"), 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got) == brute_top_k(rows, asked, 10)
    n = sum(p.count() for p in probed)
    assert 0 < n < len(asked) * len(rows) / 100
    for p in probed:
        p.unpersist()


def test_top_k_edges(spark):
    rows = [(1, [0.5, None, float("nan"), -1.0], "x"), (2, None, "x"), (3, [], "x"), (3, [], "x"), (50, [1.0] * 70, "x"), (None, [1.0] * 69, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")
    index = hamming.sign_codes(df)
    assert {(r.vec_id, *r.code) for r in index.collect()} == {(1, 1, 0), (3, 0, 0), (50, -1, 63), (None, -1, 31)}
    assert {(r.vec_id, *r.code) for r in hamming.sign_codes(df, bits=3).collect()} == {(1, 1), (3, 0), (50, -1), (None, -1)}
    twice = index.where("vec_id = 50").union(index.where("vec_id = 50"))
    got = [(r.rank, r.vec_id, r.distance) for r in hamming.top_k(index, twice, Workspace(spark, "t"), 5).orderBy("rank").collect()]
    assert got == [(1, 50, 0), (2, None, 1), (3, 1, 69), (4, 3, 70), (5, 3, 70)]
    assert [r.vec_id for r in hamming.top_k(index, index.where("vec_id is null"), Workspace(spark, "t"), 2).orderBy("rank").collect()] == [None, 50]
    assert hamming.top_k(index.limit(0), index.limit(0), Workspace(spark, "t")).count() == 0
    assert hamming.top_k(index.limit(0), index, Workspace(spark, "t")).count() == 0
