"""Token files and packing against plain encodings."""

import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import huffman, packing, tokens
from tessera.llm.huffman import Codebook, limited_lengths, read_tokens, write_tokens
from tessera.llm.packing import combinations, nnls, pack, plan
from tessera.llm.queries import QUERIES
from tessera.llm.tokens import Encoder, default_tokenizer, tokenize
from tessera.llm.workspace import Workspace

ODD = [None, "", " ", "a", "a b", "a  b", " lead", "trail ", "x\ny", "x\n\ny", "x \ny", "x\n y", "tab\tz", "n b", "it's we'll", "<|endoftext|>", "é à ç", "🙂 🙂", "a\x00b", "1234 56.7!", "a\x1cb", "word " * 3000]
SCHEMA = "doc_id long, text string, lang string, ids string, n_tokens string, part string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in rows], SCHEMA)


def test_memo_equals_library(plain):
    found = Encoder.of(default_tokenizer()).encode(ODD)
    assert [list(np.frombuffer(x, "<u4")) for x in found] == [plain(t) for t in ODD]


def test_added_tokens_as_the_library_as_loaded():
    t = Tokenizer.from_file(default_tokenizer())
    texts = ["end of part <|endoftext|> next part", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "plain words", "", "split <|endof", "text|> over two", "<|endoftext|", *[x for x in ODD if x]]
    found = Encoder.of(default_tokenizer(), literal=False).encode(texts)
    assert [list(np.frombuffer(x, "<u4")) for x in found] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in np.frombuffer(found[0], "<u4")


def test_queries_take_added_tokens_as_the_library(spark, tmp_path):
    t = Tokenizer.from_file(default_tokenizer())
    texts = ["end of part <|endoftext|> next part", "plain words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    plain = [t.encode(x, add_special_tokens=False).ids for x in texts]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    files = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_files"](spark, f"file://{tmp_path}").collect())
    assert files == [(i, len(x) + 1, crc([*x, 0])) for i, x in enumerate(plain)]
    packed = sorted((r.doc_id, r.doc_tokens) for r in QUERIES["op5_packing"](spark, f"file://{tmp_path}").select("doc_id", "doc_tokens").distinct().collect())
    assert packed == [(i, len(x) + 1) for i, x in enumerate(plain)]
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.packing(spark, docs, "").collect()} == {i: len(x) + 1 for i, x in enumerate(plain)}


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (5, 3), (300, 9), (4000, 30)])
def test_code_lengths(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
    lengths = limited_lengths(counts, limit)
    assert lengths.max() <= limit and lengths.min() >= 1
    assert n == 1 or abs(np.sum(2.0 ** -lengths.astype(float)) - 1) < 1e-12
    p = counts / counts.sum()
    assert (p * lengths).sum() <= -(p * np.log2(p)).sum() + 1.2 or limit <= 9


def test_lengths_are_optimal_on_small_alphabets():
    from itertools import product

    for counts in ([1, 1, 2, 9], [1, 2, 3, 4, 50], [5, 5, 5, 5, 5]):
        best = min(sum(c * x for c, x in zip(counts, ls)) for ls in product(range(1, 4), repeat=len(counts)) if sum(2.0**-x for x in ls) <= 1)
        assert int((np.array(counts) * limited_lengths(np.array(counts), 3)).sum()) == best


def test_codebook_round_trip():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.01, 20_000), 900) * 7
    values, n = np.unique(ids, return_counts=True)
    book = Codebook(values, limited_lengths(n, 12))
    counts = np.array([0, 1, 7000, 0, 12_999], np.int64)
    payload, offsets, places = book.encode(ids, counts)
    found = book.decode(payload, offsets[:-1] * 8, counts)
    assert (found == ids).all()


def check_files(spark, rows, plain):
    space = Workspace(spark, "t")
    tokens = space.save(tokenize(frame(spark, rows), default_tokenizer(), end_id=0), "tokens")
    got = read_tokens(spark, write_tokens(tokens, space)).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(plain(t) + [0])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted((-1 if i is None else i, len(x), zlib.crc32(array("I", x).tobytes())) for i, xs in ids.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)


def test_files_round_trip(spark, plain):
    rows = [(10 * i % 37, t) for i, t in enumerate(ODD)] + [(None, "none"), (None, None), (5, "same"), (5, "same")]
    check_files(spark, rows, plain)


def test_files_of_documents_beyond_a_block_and_a_shard(spark, plain, monkeypatch):
    monkeypatch.setattr(huffman, "SHARD_IDS", 1 << 16)
    rows = [(i, f"word{i % 9} " * (150_000 if i == 11 else 300 * i)) for i in range(40)]
    check_files(spark, rows, plain)


def test_memo_forgets_and_long_words_stay_right(plain, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_IDS", 2000)
    encoder = Encoder(default_tokenizer())
    texts = [" ".join(f"w{i * j % 997}x" for j in range(200)) for i in range(1, 30)] + ["q" * 200_000, "z1" * 90_000 + " " + "z1" * 90_000]
    for _ in range(2):
        assert [list(np.frombuffer(x, "<u4")) for x in encoder.encode(texts)] == [plain(t) for t in texts]


def test_files_of_empty_table(spark, plain):
    check_files(spark, [], plain)


def test_files_on_documents(spark, sf, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_files(spark, rows, plain)


def test_nnls_matches_projected_search():
    rng = np.random.default_rng(1)
    a, b = rng.random((6, 9)), rng.random(6)
    x = nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g <= 1e-7).all() and abs(g[x > 0]).max(initial=0) < 1e-7


def test_plan_never_overuses():
    rng = np.random.default_rng(2)
    h = rng.poisson(40, 64)
    used = np.zeros(64, int)
    for combo, n in plan(h, 64):
        assert sum(combo) == 64
        for b in combo:
            used[b - 1] += n
    assert (used <= h).all() and used.sum() > 0.8 * h.sum()
    assert all(sum(c) == 64 for c in combinations(64))


def check_packing(spark, rows, plain, window):
    got = pack(frame(spark, rows), Workspace(spark, "t"), default_tokenizer(), end_id=1, window=window).collect()
    want = sorted((-1 if i is None else i, plain(t) + [1]) for i, t in rows)
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4 > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    keyed = {}
    for r in got:
        keyed.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
    if len({i for i, _ in want}) == len(want):
        for i, ids in want:
            at, out = 0, []
            for r in sorted(keyed[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                at += r.length
                out += list(np.frombuffer(r.ids, "<u4"))
            assert out == ids
    return padding / max(1, sum(len(x) for _, x in want))


def test_packing_edges(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "none")]
    check_packing(spark, rows, plain, 2048)
    check_packing(spark, rows + [(1, ""), (1, ""), (None, None)], plain, 256)
    check_packing(spark, [], plain, 2048)


def test_packing_places_in_levels(spark, plain, monkeypatch):
    """Running sums over groups of three pieces and steps of two partitions."""
    monkeypatch.setattr(packing, "GROUP", 3)
    monkeypatch.setattr(packing, "STEP", 2)
    check_packing(spark, [(i, "a b c " * (i * 37 % 90)) for i in range(300)], plain, 256)


def test_packing_documents(spark, sf, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packing(spark, rows, plain, 2048) < 0.01
