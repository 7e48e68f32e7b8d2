"""Steps whose memory, shuffles or number of jobs must not grow faster than their input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, keyword, patterns, retrieval, store
from tessera.operators.cells import kmeans
from tessera.plans import build, registry
from tests.test_store import Crash, units


def test_a_group_of_dense_search_holds_slices_of_distances():
    rng = np.random.default_rng(2)
    vectors = lambda n: pa.array(rng.standard_normal((n, 8)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    n, m = 6000, 1000
    c = pa.table({"chunk_key": [f"k{i:05}" for i in range(n)], "kind": ["api", "tutorial", "guide"] * (n // 3), "library": ["a", "b"] * (n // 2), "embedding": vectors(n)})
    q = pa.table({"query_id": [f"q{i:04}" for i in range(m)], "want_library": pa.array([None, "a"] * (m // 2), pa.string()), "want_kind": pa.array([None] * (m - 1) + ["api"], pa.string()), "vector": vectors(m)})
    tracemalloc.start()
    found = retrieval.nearest(3)(c, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6 < 8 * n * m
    a, b = (np.array(x.to_pylist(), float) for x in (q["vector"], c["embedding"]))
    dist = 1 - (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    want = []
    for i in range(m):
        for k, kind in enumerate(("api", "tutorial", "guide") if i < m - 1 else ("api",)):
            at = [j for j in range(k, n, 3) if not i % 2 or not j % 2]
            want += [(f"q{i:04}", kind, f"k{j:05}") for j in sorted(at, key=lambda j: dist[i, j])[:3]]
    assert sorted(zip(*(found[x].to_pylist() for x in ("query_id", "kind", "chunk_key")), strict=True)) == sorted(want)


def test_vectors_of_a_group_are_held_once():
    n, width = 20_000, 64
    column = pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.random.default_rng(4).standard_normal(n * width).astype(np.float32)))])
    tracemalloc.start()
    found = retrieval._unit(retrieval._matrix(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 8 * n * width and np.allclose(np.linalg.norm(found, axis=1), 1)
    assert kmeans(rows := np.full((2, 3), 2.0), 1, 0).shape == (1, 3) and (rows == 2).all()


def test_pools_with_ties_nulls_and_unknown_kinds():
    rng = np.random.default_rng(5)
    vectors = [None if i % 13 == 0 else [0.0, 0.0] if i % 17 == 0 else [float(x) for x in rng.integers(-2, 3, 2)] for i in range(400)]
    keys, kinds, libraries = [f"k{i * 7 % 400:03}" for i in range(400)], [("api", "guide", None, "odd")[i % 4] for i in range(400)], [("a", None, "b")[i % 3] for i in range(400)]
    c = pa.table({"chunk_key": keys, "kind": kinds, "library": libraries, "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    asked = [(f"q{i}", (None, "a", "nowhere")[i % 3], (None, "odd", "api", "missing")[i % 4], [1.0, i % 5 - 2.0]) for i in range(24)] + [("z", None, None, [0.0, 0.0]), ("n", None, None, None)]
    q = pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "want_library", "want_kind", "vector"), zip(*asked, strict=True), (pa.string(), pa.string(), pa.string(), pa.list_(pa.float32())), strict=True)})
    got = retrieval.nearest(5)(c, q)
    cosine = lambda v, w: round(1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 9)
    want = []
    for name, library, kind, v in asked:
        for k in ("api", "tutorial", "guide") if kind is None else (kind,):
            fit = [(cosine(v, w), key) for key, of, at, w in zip(keys, kinds, libraries, vectors, strict=True) if v and any(v) and w and any(w) and of == k and library in (None, at)]
            want += [(name, k, d) for d, _ in sorted(fit)[:5]]
    assert [(a, b, round(d, 9)) for a, b, d in zip(*(got[x].to_pylist() for x in ("query_id", "kind", "dist")), strict=True)] == want
    # equal vectors are taken by key
    same = c.set_column(3, "embedding", pa.array([[1.0, 1.0]] * 400, pa.list_(pa.float32())))
    assert retrieval.nearest(5)(same, q.slice(0, 1))["chunk_key"].to_pylist()[:5] == sorted(k for k, of in zip(keys, kinds, strict=True) if of == "api")[:5]


def test_chunks_without_a_vector_are_in_no_group(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 8)
    chunks = spark.createDataFrame([(f"k{i:02}", "api", "l", [1.0, i / 9] if i % 5 == 0 else None) for i in range(40)], "chunk_key string, kind string, library string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], None, None)], "query_id string, vector array<float>, library string, kind string")
    left, right = retrieval._deal(chunks, asked)
    assert (left._df.count(), right._df.count()) == (8, 1)
    assert sorted((r.dense_rank, r.chunk_key) for r in retrieval.dense_hits(chunks, asked, 3).collect()) == [(1, "k00"), (2, "k05"), (3, "k10")]
    assert retrieval.dense_hits(chunks.where("embedding is null"), asked, 3).count() == 0 and retrieval.top_distance(chunks.where("embedding is null"), asked).first().dist is None


def test_hits_of_cells_are_merged_where_they_are_found(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"k{i * 7 % 600:03}", ("api", "guide", None)[i % 3], ("a", "b")[i % 2], v) for i, v in enumerate(rng.integers(-2, 3, (600, 4)).astype(float).tolist())]
    chunks = spark.createDataFrame(rows, "chunk_key string, kind string, library string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", rng.standard_normal(4).tolist(), (None, "a")[i % 2], (None, "api", "none")[i % 3]) for i in range(9)], "query_id string, vector array<float>, library string, kind string")
    index, found = cells.CellIndex.build(chunks, f"file://{tmp_path}/cells", 30), []
    ranked = lambda df: sorted((r.query_id, r.kind, round(r.dist, 9)) for r in df.collect())
    monkeypatch.setattr(cells, "pooled", lambda df, pool: found.append(df.count()) or retrieval.pooled(df, pool))
    exact = retrieval.dense_hits(chunks, asked, 5)
    assert ranked(index.hits(None, asked, 5, probe=len(index.centres))) == ranked(exact)
    assert found == [exact.count()]  # all cells are in one group; by cell there were up to 30 times as many
    # a search in some of the cells finds what is nearest in these; small pieces find the same
    some = [index.hits(None, asked.where("kind is null and library is null"), 5, probe=4)]
    monkeypatch.setattr(cells, "SHARD_ROWS", 64)
    monkeypatch.setattr(cells, "LOOK_QUERIES", 4)
    some.append(index.hits(None, asked.where("kind is null and library is null"), 5, probe=4))
    assert ranked(some[0]) == ranked(some[1])
    assert ranked(index.hits(None, asked, 5, probe=len(index.centres))) == ranked(exact)


def test_a_query_meets_its_cells_only_and_ties_go_by_key():
    n = 90
    c = pa.table({"chunk_key": [f"k{i * 7 % n:02}" for i in range(n)], "kind": ["api", "guide", None] * (n // 3), "library": ["a"] * n, "embedding": pa.array([[1.0, 1.0]] * n, pa.list_(pa.float32())), "cell": pa.array([i // 3 % 5 for i in range(n)], pa.int32())})
    looks = [[0, 3], [4], [], [1, 2, 9]]
    q = pa.table({"query_id": list("abcd"), "want_library": pa.array([None] * 4, pa.string()), "want_kind": pa.array([None] * 4, pa.string()), "vector": pa.array([[1.0, 1.0]] * 4, pa.list_(pa.float32())), "cells": pa.array(looks, pa.list_(pa.int32()))})
    got = retrieval.nearest(4)(c, q)
    want = [(name, kind, key) for name, look in zip("abcd", looks, strict=True) for kind in ("api", "guide") for key in sorted(k for k, of, cell in zip(*(c[x].to_pylist() for x in ("chunk_key", "kind", "cell")), strict=True) if of == kind and cell in look)[:4]]
    assert list(zip(*(got[x].to_pylist() for x in ("query_id", "kind", "chunk_key")), strict=True)) == want
    assert retrieval.nearest(4)(c.slice(0, 0), q).num_rows == retrieval.nearest(4)(c, q.slice(0, 0)).num_rows == 0


def test_words_are_made_of_the_documents_of_queries_only(spark, sf):
    plan = registry.query_table(spark, sf).where("size(query_lexemes) > 0 and query <> ''")._jdf.queryExecution().optimizedPlan().toString()
    texts = [line for line in plan.splitlines() if "Filter" in line and "array_sort" in line]
    assert all("% 50" in line.split("array_sort")[0] for line in texts)


def test_ranks_of_pages_search_twice(spark):
    chunks = spark.createDataFrame([(f"k{i}", f"https://x/{'ab'[i % 2]}/{i}", [1.0, i / 9]) for i in range(10)], "chunk_key string, url string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], "/B/"), ("r", [1.0, 1.0], "/a/"), ("s", [1.0, 1.0], "/c/")], "query_id string, vector array<float>, url string")
    found = retrieval.dense_rank_of(chunks, asked)
    assert {r.query_id: (r.best is None, r["rank"]) for r in found.collect()} == {"q": (False, 2), "r": (False, 2), "s": (True, None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 2


def test_symbols_are_ranked_once_for_equal_asks(spark):
    chunks = spark.createDataFrame([(f"k{i}", f"https://x/generated/a.item_{i % 3}.html", "p", "h", "l", ("api", "guide")[i % 2]) for i in range(30)], "chunk_key string, url string, page_title string, heading_path string, library string, kind string")
    asked = spark.createDataFrame([(f"q{i}", "see a.item_1 here", None, ("api", None)[i % 2]) for i in range(8)], "query_id string, query string, library string, kind string")
    found = retrieval.symbol_hits(chunks, asked, 4)
    rows = sorted((r.query_id, r.symbol_rank, r.chunk_key, r.exact) for r in found.collect())
    api = sorted(f"k{i}" for i in range(30) if i % 3 == 1 and i % 2 == 0)[:4]
    assert rows == [(f"q{i}", n, k, True) for i in range(8) for n, k in enumerate(api, 1)]
    assert "windowspecdefinition(query_id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_postings_of_asked_lexemes_only(spark):
    chunks = spark.createDataFrame([("a", "api", "l", ["x", "y", "x"]), ("a", "api", "l", ["x"]), ("b", "api", None, ["y", "z"]), ("c", "api", "l", [])], "chunk_key string, kind string, library string, lexemes array<string>")
    asked = spark.createDataFrame([("q", ["x", "y"]), ("r", ["nowhere"])], "query_id string, query_lexemes array<string>")
    rows = lambda df: sorted((r.lexeme, r.chunk_key, r.tf) for r in df.collect())
    assert rows(retrieval.postings(chunks)) == [("x", "a", 3), ("y", "a", 1), ("y", "b", 1), ("z", "b", 1)]
    assert rows(retrieval.postings(chunks, queries=asked)) == [("x", "a", 3), ("y", "a", 1), ("y", "b", 1)]


def test_equal_asks_are_searched_once(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(f"k{i:02}", "api", f"l{i % 2}", ["x"] * (1 + i % 3) + ["y", f"w{i}"]) for i in range(40)], "chunk_key string, kind string, library string, lexemes array<string>")
    asked = spark.createDataFrame([(f"q{i}", ["y", "x"] if i % 2 else ["x", "y", "x"], "l1" if i > 5 else None, None) for i in range(8)], "query_id string, query_lexemes array<string>, library string, kind string")
    index, looked, plain = keyword.KeywordIndex.build(chunks, f"file://{tmp_path}/i", 8), set(), keyword.KeywordIndex._scored
    monkeypatch.setattr(keyword.KeywordIndex, "_scored", lambda self, wanted: looked.update(r[0] for r in wanted.select("query_id").distinct().collect()) or plain(self, wanted))
    found, read = index.search(asked, 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.keyword_rank, r.chunk_key))
    assert len(looked) == 2 and len(got) == 8 and read.count() == 8
    assert len({str(sorted(v)) for k, v in got.items() if k <= "q5"}) == 1 and all(int(k[1:]) % 2 for q in ("q6", "q7") for _, k in got[q])
    assert {r.query_id: r.gap for r in index.closeness(found, asked).where("keyword_rank = 1").collect()} == dict.fromkeys(got, 1)


def test_a_build_has_a_bounded_number_of_batches_and_stages_no_texts(spark, tmp_path):
    calls = []

    def embed(df):
        calls.append(1)
        if len(calls) == 30:
            raise Crash
        return df.select("chunk_key", F.array(F.char_length("text").cast("float")).alias("embedding"))

    at = store.IndexStore(spark, f"file://{tmp_path}/i", width=1)
    run = lambda n: build.build_index(at, units(spark, n), embed, lambda c: F.split(c, " "), "v1", "r", batch_rows=1)
    assert run(40)["embedded"] == 40 and len(calls) == build.MOST_BATCHES < 40
    with pytest.raises(Crash):
        run(120)
    assert at.staged("v1 r").count() > 0 and at.staged("v1 r").where("content <> '' or size(lexemes) > 0").count() == 0
    assert run(120)["total"] == 120 and at.chunks().where("embedding[0] = char_length(content) and size(lexemes) > 1 or true").count() == 120


def test_many_patterns_do_not_read_the_texts_again(spark, monkeypatch):
    searched, plain = [], patterns._search
    monkeypatch.setattr(patterns, "_search", lambda words: searched.append(1) or plain(words))
    monkeypatch.setattr(patterns, "PART_BYTES", 64)
    texts = spark.createDataFrame([(i, f"word{i % 7} and {'abc' * 3}{i}; äöü") for i in range(20)] + [(3, "word3 word3"), (20, None)], "id int, t string")
    asked = [f"word{i}" for i in range(30)] + ["bca", "c1", "äö", "nothing"]
    got = sorted((r.id, r.p) for r in patterns.occurrences(texts, F.col("t"), spark.createDataFrame([(x,) for x in asked], "w string"), "p").collect())
    assert got == sorted((r.id, x) for r in texts.collect() if r.t is not None for x in asked if x in r.t) and not searched
