"""The kept keyword index against a ranking of everything."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.operators.keyword import KeywordIndex
from tessera.plans.registry import chunk_table, query_table

CHUNKS = "chunk_key string, kind string, library string, lexemes array<string>"
ASKED = "query_id string, query_lexemes array<string>, library string, kind string"


def brute(chunks, queries, pool):
    out = set()
    for qid, words, library, kind in queries:
        need, pools = {w for w in words or [] if w is not None}, defaultdict(list)
        for key, k, lib, lexemes in chunks:
            own = [w for w in lexemes or [] if w is not None]
            if need and need <= set(own) and (library is None or lib == library) and kind in (None, k or ""):
                score = sum(math.floor(1e6 * own.count(w) / (own.count(w) + 1) / (1 + math.log(len(own)))) for w in need)
                pools[k or ""].append((-score, key))
        for k, rows in pools.items():
            out |= {(qid, k, key, -score, i + 1) for i, (score, key) in enumerate(sorted(rows)[:pool])}
    return out


def found(index, queries, pool):
    rows, read = index.search(queries, pool, first=1)
    return {(r.query_id, r.kind, r.chunk_key, r.score, r.keyword_rank) for r in rows.collect()}, read


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    chunks = [(f"k{i:04d}", rng.choice(["api", "guide", None]), rng.choice(["a", "b", None]), rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.choice([3, 9, 40, 200]))) for i in range(600)]
    # ties, no words, null words, a long chunk
    chunks += [(f"t{i:03d}", "api", "a", ["w0", "w1", "tie"]) for i in range(60)]
    chunks += [("e1", "api", "a", []), ("e2", "api", "a", None), ("e3", "api", "a", [None, "w0", None, "w1"]), ("long", "guide", "b", ["w0", "w1"] * 20_000)]
    queries = [("q1", ["w0", "w1"], None, None), ("q2", ["w0", "w0"], "a", "api"), ("q3", ["w25", "w0", "w29"], None, "guide"), ("q4", [], None, None), ("q5", ["none", "w0"], None, None), ("q6", ["tie"], None, None), ("q7", None, None, None), ("q8", [None, "w2"], "b", None)]
    return chunks, queries


def test_ranking_equals_that_of_everything_and_reads_less(spark, made, tmp_path):
    chunks, queries = made
    index = KeywordIndex.build(spark.createDataFrame(chunks, CHUNKS), f"file://{tmp_path}/i", block_rows=8)
    asked = spark.createDataFrame(queries, ASKED)
    got, read = found(index, asked, 5)
    assert got == brute(chunks, queries, 5)
    whole = {(r.query_id, r.kind): r.postings for r in index.postings_of(asked).collect()}
    seen = {(r.query_id, r.kind): r.postings for r in read.collect()}
    assert all(n <= whole[k] for k, n in seen.items())
    assert sum(seen.values()) < sum(whole.values()) / 2


def test_changes_write_a_segment_and_an_unfinished_one_is_not_read(spark, made, tmp_path):
    chunks, queries = made
    at = f"file://{tmp_path}/i"
    index = KeywordIndex.build(spark.createDataFrame(chunks, CHUNKS), at, block_rows=8)
    before = sorted((tmp_path / "i/blocks/segment=1").iterdir())
    changed = [(k, "guide", "b", ["w0", "w1", "w1"]) for k, *_ in chunks[:20]] + [("new", "api", "a", ["w0", "w1", "w25"])]
    gone = [k for k, *_ in chunks[20:60]] + ["unknown"]
    index.change(spark.createDataFrame(changed, CHUNKS), spark.createDataFrame([(k,) for k in gone], "chunk_key string"))
    index.change(spark.createDataFrame([(chunks[20][0], "api", "a", ["w0", "w1"])], CHUNKS))
    now = {k: (k, *row) for k, *row in chunks if k not in gone} | {k: (k, *row) for k, *row in changed}
    now[chunks[20][0]] = (chunks[20][0], "api", "a", ["w0", "w1"])
    asked = spark.createDataFrame(queries, ASKED)
    assert found(KeywordIndex(spark, at), asked, 5)[0] == brute(now.values(), queries, 5)
    assert sorted((tmp_path / "i/blocks/segment=1").iterdir()) == before
    spark.createDataFrame([("w0",)], "lexeme string").write.parquet(f"{at}/blocks/segment=4")
    assert found(KeywordIndex(spark, at), asked, 5)[0] == brute(now.values(), queries, 5)
    index.change(spark.createDataFrame([("last", "api", "a", ["w0"])], CHUNKS))
    assert (tmp_path / "i/dead/segment=5/_SUCCESS").exists()
    assert {r.chunk_key for r in index.postings().where("chunk_key in ('last', 'new')").collect()} == {"last", "new"}


def test_positions_and_gaps(spark, tmp_path):
    chunks = [("a", "api", "x", ["p", "q", "r", "p", "s"]), ("b", "api", "x", ["s", "q", "q", "p"]), ("c", "api", "x", ["p"])]
    index = KeywordIndex.build(spark.createDataFrame(chunks, CHUNKS), f"file://{tmp_path}/i")
    places = {(r.lexeme, r.chunk_key): list(r.positions) for r in index.postings().collect()}
    assert places[("p", "a")] == [1, 4] and places[("q", "b")] == [2, 3] and places[("p", "c")] == [1]
    asked = spark.createDataFrame([("1", ["s", "p"], None, None), ("2", ["p"], None, None)], ASKED)
    gaps = {(r.query_id, r.chunk_key): r.gap for r in index.closeness(index.search(asked)[0], asked).collect()}
    assert gaps == {("1", "a"): 1, ("1", "b"): 3, ("2", "a"): None, ("2", "b"): None, ("2", "c"): None}


def test_nothing_in_nothing_asked(spark, tmp_path):
    index = KeywordIndex.build(spark.createDataFrame([], CHUNKS), f"file://{tmp_path}/i")
    asked = spark.createDataFrame([("1", ["s"], None, None)], ASKED)
    assert index.hits(asked).collect() == [] and index.postings().count() == 0
    full = KeywordIndex.build(spark.createDataFrame([("a", "api", "x", ["s"])], CHUNKS), f"file://{tmp_path}/j")
    assert full.hits(asked.where(F.lit(False))).collect() == []
    with pytest.raises(FileNotFoundError):
        KeywordIndex(spark, f"file://{tmp_path}/none").postings()


def test_hybrid_retrieval_takes_the_kept_index(spark, sf, tmp_path):
    chunks, asked = chunk_table(spark, sf), query_table(spark, sf)
    index = KeywordIndex.build(chunks, f"file://{tmp_path}/i")
    rank = lambda hits: {(r.query_id, r.chunk_key) for r in hits.collect()}
    want = retrieval.fused(retrieval.dense_hits(chunks, asked), index.hits(asked))
    got = retrieval.retrieve(chunks, asked, index=index)
    assert rank(got) == rank(retrieval.interleaved(retrieval.gated(want)))
