"""The store against crashes, second writers and partial changes; builds that are cut off; the cell index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, retrieval, store
from tessera.plans import build

ROW = {"embedding": "array(1.0f, 0.0f)", "lexemes": "array('x')", "part": "0", "ordinal": "0"}


def rows(spark, keys, content="c"):
    df = spark.createDataFrame([(k, content) for k in keys], "chunk_key string, content string")
    return df.select(*[F.col(c) if c in df.columns else F.expr(ROW.get(c, "''")).alias(c) for c in store.COLUMNS])


def contents(at):
    return {r.chunk_key: r.content for r in at.chunks().select("chunk_key", "content").collect()}


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_write", "_commit", "create", "half"])
def test_a_crash_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    at = store.IndexStore(spark, f"file://{tmp_path}/i", width=2, buckets=4)
    at.replace(rows(spark, "abcdef"))
    before = contents(at)

    def crash(*a, **k):
        raise Crash

    if step in ("_write", "_commit"):
        monkeypatch.setattr(store.IndexStore, step, crash)
    else:
        plain = store.IndexStore._fs

        def broken(self, name):
            fs, place = plain(self, name)
            if name.endswith("_now_000000000002"):
                if step == "half":  # the pointer is there, but not its content
                    fs.create(place, False).close()
                raise Crash
            return fs, place

        monkeypatch.setattr(store.IndexStore, "_fs", broken)
    with pytest.raises(Crash):
        at.upsert(rows(spark, "abz", "new"))
    monkeypatch.undo()
    again = store.IndexStore(spark, f"file://{tmp_path}/i", width=2)
    assert contents(again) == before
    again.upsert(rows(spark, "abz", "new"))
    assert contents(again) == before | dict.fromkeys("abz", "new")


def test_a_second_writer_of_a_bucket_fails(spark, tmp_path):
    first, second = (store.IndexStore(spark, f"file://{tmp_path}/i", buckets=1) for _ in range(2))
    first.replace(rows(spark, "ab"))

    def meanwhile(old):
        second.upsert(rows(spark, "c", "second"))
        return store.merged(old, rows(spark, "a", "first"))

    with pytest.raises(store.Conflict):
        first.change(rows(spark, "a"), meanwhile)
    assert contents(first) == {"a": "c", "b": "c", "c": "second"}


def test_only_touched_buckets_are_written(spark, tmp_path):
    at = store.IndexStore(spark, f"file://{tmp_path}/i", buckets=8)
    at.replace(rows(spark, [f"k{i}" for i in range(100)]))
    before = at._pointers("chunks")[0][1]
    assert at.change(rows(spark, ["k1"]), lambda old: store.merged(old, rows(spark, ["k1"], "new"))) == 1
    after = at._pointers("chunks")[0][1]
    assert sum(before[b] != after[b] for b in before) == 1 and contents(at)["k1"] == "new" and len(contents(at)) == 100
    at.delete(at.chunks().select("chunk_key"))
    assert contents(at) == {} and at.change(rows(spark, []), lambda old: old) == 0
    assert len([n for n in at._names("_chunks_now_")]) == 2  # older pointers are gone


def units(spark, n):
    full = [(f"https://x/docs/{i}.html", "a", "t", ["H"], "l", "api", "", f"h{i}", 0, "", f"text {i}", i) for i in range(n)]
    return spark.createDataFrame(full, "url string, anchor string, page_title string, heading_path array<string>, library string, kind string, source_link string, content_hash string, part int, synopsis string, content string, ordinal int")


def test_a_build_that_was_cut_off_embeds_only_the_rest(spark, tmp_path):
    at, seen, calls = store.IndexStore(spark, f"file://{tmp_path}/i", width=2), [], []

    def embed(df):
        calls.append(1)
        if len(calls) == 3:
            raise Crash
        seen.extend(r.chunk_key for r in df.collect())
        return df.select("chunk_key", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))

    run = lambda: build.build_index(at, units(spark, 40), embed, lambda c: F.split(c, " "), "v1", "r", batch_rows=8)
    with pytest.raises(Crash):
        run()
    done = len(seen)
    assert 0 < done < 40 and at.chunks().count() == 0 and at.staged("v1 r").count() == done
    stats = run()
    assert stats["embedded"] == 40 - done and stats["total"] == 40 and len(seen) == len(set(seen)) == 40
    assert at._names("_staged-") == [] and run()["embedded"] == 0


def test_one_handle_for_all_threads(spark, tmp_path):
    assert store.shared_store(spark, f"file://{tmp_path}/i") is store.shared_store(spark, f"file://{tmp_path}/i/")


def test_cells_recall_and_widening(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    points = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    kinds = rng.choice(["api", "tutorial", "guide"], 3000, p=[0.5, 0.49, 0.01])
    chunks = spark.createDataFrame([(f"{i:05d}", kinds[i], f"l{i % 50}", points[i].tolist()) for i in range(3000)] + [("null", "api", "l0", None), ("zero", "api", "l0", [0.0] * 16)], "chunk_key string, kind string, library string, embedding array<float>")
    asked = [(f"q{i}", points[i * 37].tolist(), "l7" if i % 3 == 0 else None, None if i % 2 else "api") for i in range(12)] + [("none", [0.0] * 16, None, None)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>, library string, kind string")
    index = cells.CellIndex.load(spark, cells.CellIndex.build(chunks, f"file://{tmp_path}/cells", 40) and f"file://{tmp_path}/cells")
    assert index.rows.count() == 3001 and len(index.centres) == 40
    pairs = lambda df: {(r.query_id, r.kind, r.chunk_key) for r in df.collect()}
    exact = pairs(retrieval.dense_hits(chunks, queries, 10))
    assert pairs(index.hits(None, queries, 10, probe=40)) == exact
    some = pairs(index.hits(None, queries, 10, probe=6))
    assert len(some & exact) / len(exact) >= 0.9 and len(some) == len(exact)  # pools that filters leave short are filled by widening
    plain = queries.select("query_id", "vector", F.lit(None).cast("string").alias("library"), F.lit(None).cast("string").alias("kind"))
    exact, found = pairs(retrieval.dense_hits(chunks, plain, 10)), pairs(index.hits(None, plain, 10))
    assert 1 <= index.probe < 40 and len(found & exact) / len(exact) >= 0.9
    assert sum(cells._shares({0: 900, 1: 5, 2: 95}, 40).values()) == 40 and min(cells._shares({0: 900, 1: 5, 2: 95}, 40).values()) == 1
    assert max(cells._shares({0: 10**6, 1: 1}, 10**5).values()) == cells.FINE
    assert pairs(retrieval.dense_hits(chunks.limit(0), queries, 10)) == set()
    assert cells.CellIndex.build(chunks.limit(0), f"file://{tmp_path}/none").hits(None, queries, 10).count() == 0


def keys_by_bucket(at, n=40):
    """Keys of each bucket."""
    out = {}
    for r in at.spark.createDataFrame([(f"k{i}",) for i in range(n)], "chunk_key string").withColumn("b", at._bucket()).collect():
        out.setdefault(r.b, []).append(r.chunk_key)
    return out


def test_layers_say_what_a_rewrite_would(spark, tmp_path, monkeypatch):
    """Random changes against a dictionary, with bases left alone, then compacted."""
    at, want, rng = store.IndexStore(spark, f"file://{tmp_path}/i", buckets=2), {}, np.random.default_rng(1)
    monkeypatch.setattr(store, "LAYER_SHARE", 1e9)
    at.replace(rows(spark, [f"k{i}" for i in range(20)]))
    base = {b: fs[0] for b, fs in at._current("chunks").layers.items()}
    want = {f"k{i}": "c" for i in range(20)}
    for step in range(4):
        some = [f"k{i}" for i in rng.integers(0, 30, 5)]
        if step % 2:
            at.delete(rows(spark, some))
            want = {k: v for k, v in want.items() if k not in some}
        else:
            at.upsert(rows(spark, sorted(set(some)), f"v{step}"))
            want |= dict.fromkeys(some, f"v{step}")
        assert contents(at) == want
    assert {b: fs[0] for b, fs in at._current("chunks").layers.items()} == base
    assert at.compact() == 2 and contents(at) == want and at.compact() == 0
    assert all(len(fs) == 1 for fs in at._current("chunks").layers.values())
    monkeypatch.setattr(store, "MOST_LAYERS", 1)
    at.upsert(rows(spark, ["k1"], "last"))
    assert all(len(fs) == 1 for fs in at._current("chunks").layers.values()) and contents(at) == want | {"k1": "last"}


def test_writers_of_different_buckets_both_commit(spark, tmp_path):
    first, second = (store.IndexStore(spark, f"file://{tmp_path}/i", buckets=4) for _ in range(2))
    a, b = [ks[0] for ks in list(keys_by_bucket(first).values())[:2]]
    first.replace(rows(spark, [a, b]))

    def meanwhile(old):
        second.upsert(rows(spark, [b], "second"))
        return store.merged(old, rows(spark, [a], "first"))

    assert first.change(rows(spark, [a]), meanwhile) == 1
    assert contents(first) == contents(second) == {a: "first", b: "second"}


def test_a_sweep_leaves_writers_at_work_alone(spark, tmp_path, monkeypatch):
    first, second = (store.IndexStore(spark, f"file://{tmp_path}/i", buckets=4) for _ in range(2))
    a, b = [ks[0] for ks in list(keys_by_bucket(first).values())[:2]]
    first.replace(rows(spark, [a, b]))
    plain = store.IndexStore._rebase

    def swept(self, *args):
        monkeypatch.setattr(store.IndexStore, "_rebase", plain)
        for k in range(3):  # the folder of the first writer is written and not yet named
            second.upsert(rows(spark, [b], f"v{k}"))
        plain(self, *args)

    monkeypatch.setattr(store.IndexStore, "_rebase", swept)
    first.upsert(rows(spark, [a], "first"))
    assert contents(first) == {a: "first", b: "v2"}
    (tmp_path / "i" / "chunks-dead").mkdir()
    monkeypatch.setattr(store, "LEASE_SECONDS", -1.0)
    first.upsert(rows(spark, [a], "again"))
    assert "chunks-dead" not in first._names("chunks-") and contents(second) == {a: "again", b: "v2"}


def test_a_batch_that_is_played_again_changes_nothing(spark, tmp_path, monkeypatch):
    at = store.IndexStore(spark, f"file://{tmp_path}/i", buckets=4)
    at.replace(rows(spark, "ab"))
    assert at.heal(rows(spark, "a", "healed"), ("pages seen", 3)) == 1
    number = at._current("chunks").number
    assert at.heal(rows(spark, "a", "late"), ("pages seen", 3)) == 0 == at.heal(rows(spark, "a", "older"), ("pages seen", 2))
    assert at._current("chunks").number == number and contents(at)["a"] == "healed"

    def crash(*a, **k):
        raise Crash

    monkeypatch.setattr(store.IndexStore, "_commit", crash)
    with pytest.raises(Crash):  # between the write and the pointer
        at.heal(rows(spark, "b", "healed"), ("pages seen", 4))
    monkeypatch.undo()
    assert contents(at)["b"] == "c"
    assert at.heal(rows(spark, "b", "healed"), ("pages seen", 4)) == 1 and at.heal(rows(spark, "b", "x"), ("other", 0)) == 1
    assert contents(at) == {"a": "healed", "b": "x"} and at._current("chunks").batches == {"pages seen": 4, "other": 0}


def test_an_unchanged_build_writes_no_bucket(spark, tmp_path):
    at = store.IndexStore(spark, f"file://{tmp_path}/i", width=2, buckets=4)
    embed = lambda df: df.select("chunk_key", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    run = lambda u: build.build_index(at, u, embed, lambda c: F.split(c, " "), "v1", "r")
    run(units(spark, 30))
    assert at.written == 4
    before = at._current("chunks")
    assert run(units(spark, 30)) == {"snapshot_chunks": 30, "embedded": 0, "purged": 0, "total": 30} and at.written == 0
    assert at._current("chunks") == before and at._names("_work-") == []
    assert run(units(spark, 29)) == {"snapshot_chunks": 29, "embedded": 0, "purged": 1, "total": 29} and at.written == 1
    with pytest.raises(ValueError):
        run(units(spark, 0))
    assert at.chunks().count() == 29


def test_stored_pages_in_order(spark):
    parts = [("u", f"{9 - i}", i, 0, f"h{i % 2}", f"t{i}" if i != 2 else "") for i in range(10)] + [("e", "x", 0, 0, "", "")]
    df = spark.createDataFrame([(*p, "title") for p in parts], "url string, chunk_key string, ordinal int, part int, heading_path string, content string, page_title string")
    found = lambda n: {r.url: (r.page_title, r.text) for r in retrieval.stored_pages(df, n).collect()}
    assert found(99) == {"u": ("title", "\n\n".join(f"t{i}" for i in range(10) if i != 2)), "e": ("title", "")}
    assert found(10)["u"] == ("title", "h0\nh1")
