"""Substring, line and near-duplicate removal against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import lines, minhash, ranges, substrings
from tessera.llm.components import connected
from tessera.llm.substrings import remove_repeats
from tessera.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, chunk string, h string, n long"
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (None, "a b c d e f g"), (None, "a b c d e f g"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "x " * 4000), (8, "é b c\x85d e f"), (9, "A B C D E F G")]


def test_bands_miss_as_few_as_promised():
    for percent in range(5, 100):
        bands, rows = minhash.bands_for(percent / 100)
        assert (1 - (percent / 100) ** rows) ** bands <= 1.0000001e-6
    assert (minhash.bands_for(0.80), minhash.bands_for(0.85)) == ((27, 4), (24, 5))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{n % 3}" if n % 5 else None, "c", "h", n) for n, (i, t) in enumerate(rows)], SCHEMA)


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def brute_substrings(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if key is None else key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found_substrings(spark, rows, width):
    got = remove_repeats(frame(spark, rows), width).select("row.doc_id", "n_words", "n_removed", "kept", "spans").collect()
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_substrings_edges(spark, width):
    assert found_substrings(spark, EDGES, width) == brute_substrings(EDGES, width)


def test_substrings_in_many_chunks_and_ranges(spark, monkeypatch):
    """Small chunks and ranges, so that windows meet over both; repeated rows and rows without a key in numbers."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substrings, "RANGE_WINDOWS", 64)
    monkeypatch.setattr(substrings, "FILL", 0)
    rng = np.random.default_rng(12)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    shared = say(30)
    rows = [(i, say(60) + (" " + shared if i % 7 == 0 else "")) for i in range(150)] + [(None, say(20))] * 40 + [(9, "one two three four five six")] * 40 + [(None, None)] * 20
    got = remove_repeats(frame(spark, rows).repartition(6), 4).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == brute_substrings(rows, 4)


def test_ranges_are_even_and_hold_whole_keys(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) as k").union(spark.sql("select cast(null as long)"))
    cuts = ranges.borders(df, "k", 40, 20_001)
    assert len(cuts) <= 39 and (np.diff(cuts) > 0).all()
    sizes = np.bincount(np.searchsorted(cuts, [r.k for r in df.where("k is not null").collect()], "right"))
    assert np.sort(sizes)[-2] < 3 * 20_000 / 40
    assert len(ranges.borders(df, "k", 1, 20_001)) == 0 and len(ranges.borders(df.limit(0), "k", 9, 0)) == 0
    monkeypatch.setattr(ranges, "MOST_RANGES", 5)
    assert len(ranges.borders(df, "k", 40, 20_001)) <= 4


def test_substrings_empty(spark):
    assert found_substrings(spark, [], 35) == []


def test_substrings_documents(spark, sf):
    rows = documents(spark, sf)
    want = brute_substrings(rows, 35)
    assert sum(r[2] for r in want) > 0
    assert found_substrings(spark, rows, 35) == want


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(spark, rows, k, percent):
    want = brute_near(rows, k, percent)
    got = minhash.near_duplicates(frame(spark, rows), Workspace(spark, "t"), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    return want


def test_near_edges(spark):
    check_near(spark, EDGES, 3, 85)
    check_near(spark, [], 3, 85)
    check_near(spark, [(1, None), (2, "")], 5, 80)


def test_near_documents(spark, sf):
    want = check_near(spark, documents(spark, sf), 3, 85)
    assert sum(i != c for i, (_, c) in want.items()) > 3


def test_near_chains_of_edits(spark):
    """Families whose members drift apart: links exist between neighbours that no hub has."""
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
        for _ in range(25):
            words = list(words)
            for p in rng.integers(0, 120, 2):
                words[p] = f"v{rng.integers(0, 10**6)}"
            rows.append((at * 7 % 1009, " ".join(words)))
            at += 1
    want = check_near(spark, rows, 3, 85)
    assert 6 <= len({c for _, c in want.values()}) < 60


def test_near_with_small_blocks(spark, monkeypatch):
    """The same families when blocks hold three members or few elements, and a hub meets two members in a task."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "FAN", 2)
    test_near_chains_of_edits(spark)
    monkeypatch.setattr(minhash, "BLOCK", 512)
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", 400)
    test_near_chains_of_edits(spark)


def test_near_long_texts_and_ids_with_several_texts(spark):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    long = say(60_000)
    a, b = say(80), say(80)
    rows = [(1, long), (2, long + " more words here"), (3, say(60_000)), (4, a), (5, b), (6, a), (6, b), (7, None), (7, a)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t"), 3, 85).collect()}
    assert got[(2, 60_001)] == 1 and got[(3, 59_998)] == 3
    assert got[(4, 78)] == got[(5, 78)] == got[(6, 78)] == got[(7, 78)] == 4 and got[(7, 0)] == 7


def test_tables_go_when_they_are_not_needed(spark, monkeypatch):
    import os

    from tessera.llm import workspace

    there = lambda s: sorted(os.listdir(s.path.removeprefix("file://"))) if os.path.isdir(s.path.removeprefix("file://")) else []
    df = spark.createDataFrame([(i, "a b c d e f " + "xy"[i % 2] * 3) for i in range(20)], "doc_id long, text string")
    space = Workspace(spark, "t")
    minhash.near_duplicates(df, space).collect()
    assert not {"members", "stars", "sets", "links", "more"} & set(there(space)) and "profiles" in there(space)
    with workspace.scratch():
        inside = Workspace(spark, "t")
        inside.save(df, "x")
        assert there(inside) == ["x"]
    assert there(inside) == []
    kept = Workspace(spark, "t", space.path + "-own")
    assert kept.path.endswith("-own")
    monkeypatch.setattr(workspace, "on_one_machine", lambda s: False)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        with pytest.raises(ValueError):
            workspace.checkpoint_root(spark)


def test_sketch_matches_similarity():
    rng = np.random.default_rng(5)
    for shared, own in ((40, 10), (300, 60), (5, 1)):
        a = np.unique(rng.integers(0, 2**63, shared + 2 * own).astype(np.uint64))
        x, y = np.sort(a[: shared + own]), np.sort(np.concatenate([a[:shared], a[shared + own :]]))
        s = np.concatenate([minhash.sketch(np.concatenate([x + np.uint64(i), y + np.uint64(i)]), np.array([len(x), len(y)]), 256).reshape(2, -1)[:, None] for i in range(20)], axis=1)
        assert (s != np.iinfo(np.uint64).max).all()
        assert abs((s[0] == s[1]).mean() - shared / (shared + 2 * own)) < 0.04


def test_block_links_join_all():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    every = [(i, i, s) for i, s in enumerate(sets)]
    found = minhash.block_links(every, every, 50)
    top = list(range(60))

    def find(t, i):
        while t[i] != i:
            i = t[i]
        return i

    for a, b in found:
        assert minhash.linked(sets[a], sets[b], 50)
        top[find(top, a)] = find(top, b)
    other = list(range(60))
    for a in range(60):
        for b in range(a):
            if minhash.linked(sets[a], sets[b], 50):
                other[find(other, a)] = find(other, b)
    assert len({find(top, i) for i in range(60)}) == len({find(other, i) for i in range(60)})
    assert len(found) == 60 - len({find(other, i) for i in range(60)})


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 240)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 5 for i in [5, *range(200, 240)])
    assert got[300] == got[299] == 299 and 7 not in got


def found_lines(spark, df):
    got = lines.remove_boilerplate(df, Workspace(spark, "t")).select("row.doc_id", "n_lines", "n_removed", "kept").collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, None if r.kept is None else hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)


def test_lines_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(lines.ORACLE).fetchall())
    assert sum(r[2] for r in want) > 0
    assert found_lines(spark, spark.read.parquet(f"{sf}/documents.parquet")) == want


def test_lines_edges(spark):
    rows = [(i, f"menu\nown {i}\n\n  menu ", f"site{i}") for i in range(12)]
    rows += [(20, None, "site1"), (21, "", None), (22, "menu", None), (None, "menu\nx", "site2"), (None, "menu\nx", "site2"), (23, "rare\n\nrare", "site3")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, source string, row string, kept string, n_lines long")
    got = lines.remove_boilerplate(df, Workspace(spark, "t")).select("row.*", F_alias("kept", "out"), F_alias("n_removed", "gone")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): (r.out, r.gone) for r in got}
    assert by[(3, rows[3][1])] == ("own 3\n", 2)
    assert by[(20, None)] == (None, 0) and by[(21, "")] == ("", 0) and by[(22, "menu")] == ("", 1)
    assert by[(None, "menu\nx")] == ("x", 1) and by[(23, "rare\n\nrare")] == ("rare\n\nrare", 0)
    assert lines.remove_boilerplate(df.limit(0), Workspace(spark, "t")).count() == 0


def test_lines_without_ansi(spark, sf):
    """Counts of documents without boilerplate are 0 whatever the session's dialect."""
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        test_lines_against_sql(spark, sf)
        test_lines_edges(spark)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_lines_of_long_texts(spark):
    body = "\n".join(f"line {i}" if i % 3 else "menu" for i in range(30_000))
    rows = [(0, body, "s0"), (1, "x" * 2_000_000, "s1")] + [(i, "menu", f"s{i}") for i in range(2, 12)]
    got = {r.doc_id: r for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), Workspace(spark, "t")).select("row.doc_id", "n_lines", "n_removed", "kept").collect()}
    assert (got[0].n_lines, got[0].n_removed) == (30_000, 10_000) and got[0].kept == "\n".join(x for x in body.split("\n") if x != "menu")
    assert got[1].n_removed == 0 and len(got[1].kept) == 2_000_000


def test_lines_near_the_threshold_are_counted_exactly(spark):
    """Nine sites carry a line at many places, ten another one."""
    rows = [(i, "\n".join([f"own {i}"] * (i % 4) + ["nine"] * (i % 9 != 8 or i < 9)), f"site{i % 9}") for i in range(40)]
    rows += [(100 + i, "\n" * (i % 3) + "ten", f"site{i % 10}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.text.strip().split("\n")[-1]: r.n for r in lines.remove_boilerplate(df, Workspace(spark, "t")).select("row.text", F_alias("n_removed", "n")).collect()}
    assert gone["nine"] == 0 and gone["ten"] == 1


def F_alias(name, alias):
    from pyspark.sql import functions as F

    return F.col(name).alias(alias)
