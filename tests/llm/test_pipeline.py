"""The pipeline's stages on a small corpus with planted cases, and each stage's columns."""

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import crf
from tests.llm.test_dedup import brute_near, brute_substrings


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of two languages with copies, near copies, a shared passage, boilerplate and junk."""
    rng = np.random.default_rng(9)
    vocabulary = {"en": [f"{a}{b}ing" for a in "bcdfgh" for b in ("a", "o", "ui")] + ["the", "and", "of"], "fr": [f"{a}{b}eau" for a in "lmnprs" for b in ("é", "è", "ou")] + ["le", "et", "de"]}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    rows, passage = [], say("en", 60)
    for i in range(80):
        lang = "en" if i % 2 else "fr"
        text = say(lang, 120) + "\n" + say(lang, 80)
        if i % 3 == 0:
            text += "\nAll rights reserved."
        if i in (11, 13, 17):
            text += "\n" + passage
        rows.append((i, text, lang, f"src{i % 14}"))
    rows += [(100 + j, rows[5][1], "en", "src1") for j in range(3)]
    words = rows[7][1].split(" ")
    rows += [(110 + j, " ".join([*words[:50], f"edit{j}", *words[51:]]), "en", "src2") for j in range(4)]
    rows += [(120, "12345 ### 777", "en", "src3"), (121, "", "fr", "src3"), (122, None, None, None), (None, say("fr", 90), "fr", "src4")]
    folder = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(i, t, lang, s, len(t or ""), "extra") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    df.write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}", rows


def stage_rows(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append((name, docs.collect()))
        docs = spark.createDataFrame(out[-1][1], docs.schema)
    return out


def test_stages(spark, corpus):
    folder, rows = corpus
    result = dict(stage_rows(spark, folder))
    for name in list(result)[:-1]:
        assert all(list(r.asDict()) == list(corpus_pipeline.COLUMNS) for r in result[name])
        assert all(r.n_chars == len(r.text or "") for r in result[name]) or name == "language_id"
    ids = lambda name: {r.doc_id for r in result[name]}
    assert ids("language_id") == {i for i, *_ in rows} - {120, 121, 122}
    assert ids("line_dedup") == ids("language_id")
    assert not any("All rights reserved." in r.text.split("\n") for r in result["line_dedup"])
    before = [(r.doc_id, r.text) for r in result["line_dedup"]]
    groups = brute_near(before, 5, 80)
    assert ids("near_dedup") == {i for i, (_, c) in groups.items() if i == c} | {None}
    assert not ids("near_dedup") & {100, 101, 102, 110, 111, 112, 113} and {5, 7} <= ids("near_dedup")
    texts = [(r.doc_id, r.text) for r in result["near_dedup"]]
    removed = {i: n for i, _, n, _ in brute_substrings(texts, 35)}
    assert all(removed[i] > 0 for i in (11, 13, 17))
    kept = {r.doc_id: r.text for r in result["substring_dedup"]}
    for i, t in texts:
        if i is not None:
            assert (kept[i] == t) == (removed[i] == 0)
    assert {r.doc_id for r in result["packing"]} == ids("substring_dedup")
    whole = {}
    for r in result["packing"]:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in result["packing"])


def test_code_switched_text_stays(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    _, rows = crf.learned_rows(docs)
    model = crf.fit(crf.labelled_sample(rows, "lang", "text", "doc_id"))
    by = {x: docs.where((docs.lang == x) & (docs.n_chars > 4000)).orderBy("doc_id").first().text.split() for x in ("fr", "de", "es")}
    mixed = "\n".join(" ".join(by[x][:n]) for x, n in (("fr", 200), ("de", 170), ("es", 170)))
    more = spark.createDataFrame([(-5, mixed, None, "s", len(mixed))], docs.schema)
    found = crf.identify(more, model).first()
    assert found.score < corpus_pipeline.LEAST_SCORE < found.certainty
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert -5 in kept


def test_run_equals_stages(spark, corpus):
    folder, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.select("doc_id").distinct().count() == len({r.doc_id for r in dict(stage_rows(spark, folder))["packing"]})
    assert corpus_pipeline.ORACLE_SQL is None


def test_very_long_texts(spark, corpus, tmp_path):
    """A text of a million characters goes through all stages whole; nothing but the result is left."""
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(10)
    text = " ".join(rng.permutation(np.array([f"thing{a}and{b}ing" for a in "bcdfghjklmnp" for b in range(4000)])))
    more = spark.createDataFrame([(500, text, "en", "src1", len(text), "extra")], docs.schema)
    docs.unionByName(more).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect() if r.doc_id == 500]
    assert sum(r.length for r in got) == got[0].doc_tokens > len(text) / 10


def test_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
