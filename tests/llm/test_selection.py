"""Importance resampling, decontamination and spelling variants against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import importance, phrases, queries, variants
from tessera.llm.workspace import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, k string, t long, n long, row string"
LONG = "word other Third " * 4_000
EDGES = [(1, None), (2, ""), (3, " \n\t.,"), (4, "One"), (None, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (5, "a B c, d e-f g h i j k l"), (5, "a B c, d e-f g h i j k l"), (6, "É İ ǅ \x85x \x00y"), (7, LONG)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 9, "r") for i, t in rows], SCHEMA)


def brute_importance(rows, target, buckets=10_000, max_n=1, percent=10, least=20, seed=2024):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(place(f) for _, x in rows for f in features(x)), Counter(place(f) for x in target for f in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(y)) for y in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found_importance(spark, rows, target, **kw):
    docs, aim = frame(spark, rows), spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(docs.repartition(3), aim, Workspace(spark, "t"), **kw)
    return sorted((tuple(r) for r in got.select("row.doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"max_n": 3, "buckets": 50, "percent": 60}])
def test_importance_edges(spark, kw):
    target = [None, "", "a b c", "third third word"]
    assert found_importance(spark, EDGES, target, min_words=0, **kw) == brute_importance(EDGES, target, least=0, **kw)
    assert found_importance(spark, EDGES, [], min_words=5, **kw) == brute_importance(EDGES, [], least=5, **kw)
    assert found_importance(spark, [], target, **kw) == []


def test_importance_ranks_over_many_ranges(spark, monkeypatch):
    """Ties in numbers, and a percentile that promises too much."""
    rng = np.random.default_rng(3)
    rows = [(int(i) if i % 9 else 5, " ".join(f"w{x}" for x in rng.integers(0, 60, 24))) for i in range(800)]
    target = [" ".join(f"w{x}" for x in range(20))]
    want = brute_importance(rows, target, percent=35)
    assert found_importance(spark, rows, target, percent=35) == want
    monkeypatch.setattr(importance, "_ACCURACY", 2)
    assert found_importance(spark, rows, target, percent=35) == want


def test_importance_gains_are_one_literal(spark):
    rows = importance.bucketed(frame(spark, EDGES), "doc_id")
    plan = importance.scored(rows, [1] * 10_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "element_at([1,1," in plan


def brute_hits(rows, items, window=10):
    places = defaultdict(list)
    for i, x in items:
        w = words(x)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            places[tuple(w[s : s + window])].append("" if i is None else str(i))
    sizes = {len(p) for p in places}
    out = []
    for i, x in rows:
        w, hit, named = words(x), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in places:
                    hit |= set(range(s, s + n))
                    named |= set(places[tuple(w[s : s + n])])
        out.append((i, len(w), len(hit), len(named), ",".join(sorted(named)), bool(hit)))
    return sorted(out, key=repr)


def found_hits(spark, rows, items, window=10):
    tests = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, term int")
    got = phrases.contamination(frame(spark, rows).repartition(3), tests, Workspace(spark, "t"), window)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got.collect()), key=repr)


@pytest.mark.parametrize("window", [3, 10])
def test_contamination_edges(spark, window):
    items = [(10, "A b c d e f g h i j"), (9, "c d e f g h i j k l m"), (9, "word other third"), (None, "one"), (None, "x"), (4, ""), (3, None), (2, "third word"), (11, "a a a a a a a a a a"), (12, "nowhere to be found at all in any of the texts")]
    rows = [*EDGES, (20, "a " * 15), (21, "third. Third WORD! other"), (22, "x a b c d e f g h i j a b c d e f g h i j k l m x")]
    got = found_hits(spark, rows, items, window)
    assert got == brute_hits(rows, items, window)
    assert any(r[5] for r in got)
    assert found_hits(spark, [], items, window) == []
    assert found_hits(spark, rows, [], window) == brute_hits(rows, [], window)


def test_contamination_of_random_words(spark):
    """Few words, so that lists are long and windows overlap with themselves."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("abcd"[x] for x in rng.integers(0, 4, n))
    rows, items = [(i, say(300)) for i in range(40)], [(i, say(int(n))) for i, n in enumerate(rng.integers(1, 12, 60))]
    assert found_hits(spark, rows, items, 5) == brute_hits(rows, items, 5)


def test_phrases_and_nearness(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("abcdefg"[x] for x in rng.integers(0, 7, 60))) for i in range(30)]
    asked = [(0, ["a", "b"]), (1, ["g", "a", "a"]), (2, ["c"]), (3, []), (4, ["zz", "a"]), (5, ["a", "b", "c", "d", "e"])]
    index = phrases.PhraseIndex(frame(spark, rows), Workspace(spark, "t"))
    ask = spark.createDataFrame(asked, "id long, words array<string>")
    want = sorted((q, i, s, len(p)) for q, p in asked if p for i, x in rows for s in range(61 - len(p)) if x.split()[s : s + len(p)] == p)
    assert sorted(map(tuple, index.phrase_matches(ask).collect())) == want
    freq = Counter(w for _, x in rows for w in x.split())
    for span in (1, 3, 6):
        near = set()
        for q, p in asked:
            p = list(dict.fromkeys(p))
            if not p or any(w not in freq for w in p):
                continue
            first = min(p, key=lambda w: (freq[w], p.index(w)))
            for i, x in rows:
                w = x.split()
                for at in range(60):
                    starts = [s for s in range(max(0, at - span + 1), at + 1) if set(p) <= set(w[s : s + span])] if w[at] == first else []
                    if starts:
                        near.add((q, i, at, starts[0]))
        assert sorted(map(tuple, index.proximity_matches(ask, span).collect())) == sorted(near)


def brute_near(counts):
    deleted = defaultdict(set)
    for w in counts:
        for p in range(len(w)):
            deleted[(p, w[:p] + w[p + 1 :])].add(w)
    near = defaultdict(set)
    for (p, rest), ws in deleted.items():
        for a in ws:
            near[a] |= ws - {a}
            if rest in counts:
                near[a].add(rest)
                near[rest].add(a)
    return near


def brute_variants(counts, ratio=2):
    near, out, form = brute_near(counts), [], {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_counts(rows, least=5, count=3, every=97):
    seen = Counter()
    for i, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(x)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= count}


@pytest.mark.parametrize("block", [2, 128])
def test_variants_of_random_words(spark, block):
    """Words over few letters, so that blocks are large and edits ambiguous; blocks are cut down to one open place."""
    rng = np.random.default_rng(5)
    counts = {"".join("abé"[x] for x in rng.integers(0, 3, n)): int(c) for n, c in zip(rng.integers(1, 8, 400), rng.integers(1, 400, 400))}
    counts |= {"a" * n: 3**n for n in range(1, 12)} | {"x" * 9_000: 3, "x" * 9_001: 9, "×÷×÷×": 4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = variants.near_words(words, Workspace(spark, "t"), block).collect()
    assert len(pairs) == len({frozenset((r.a, r.b)) for r in pairs})
    got = variants.spelling_variants(words, Workspace(spark, "t"), block=block)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(counts)


def test_variants_edges(spark):
    rows = [*EDGES, (8, "Hello hello HELLO hellö hellö hellö hallo-hallo hallo Ûberx ûberx"), (None, "hello " * 2000), (9, "Ünder únder Ünder ünder ĀBCDEFG " * 9)]
    for every in (None, 2):
        counts = brute_counts(rows, every=every)
        found = variants.word_counts(frame(spark, rows), every=every)
        assert {r.word: r.n for r in found.collect()} == counts
        got = variants.spelling_variants(found, Workspace(spark, "t"))
        assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(counts)
    none = variants.word_counts(frame(spark, []))
    assert variants.spelling_variants(none, Workspace(spark, "t")).collect() == []


def test_selection_queries_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    collect = lambda q, *c: sorted((tuple(r) for r in q(spark, sf).select(*c).collect()), key=repr)
    assert collect(queries.op11_importance, "doc_id", "n_features", "weight", "score", "rank") == brute_importance(rows, [x for _, x in items])
    want = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest(), r[5]) for r in brute_hits(rows, items)]
    assert collect(queries.op12_decontamination, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert sorted(collect(queries.op13_spelling_variants, "word", "form", "root", "n", "n_near", "form_n")) == brute_variants(brute_counts(rows))
