"""Column functions and the chunker on their own inputs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import embed_dims, env_float
from tessera.functions import text as tx
from tessera.functions.lexemes import lexemes, stem
from tessera.functions.vectors import cosine_distance, normalized
from tessera.operators import chunking, html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_slug_and_headings(spark):
    assert one(spark, tx.slug(F.lit("  Hello, World! 2 "))) == "hello-world-2"
    raw = F.lit('SGD\\_x [¶](#torch.optim.SGD "Permalink")')
    assert one(spark, tx.heading_title(raw)) == "SGD_x" and one(spark, tx.heading_anchor(raw)) == "torch.optim.SGD"
    assert one(spark, tx.heading_anchor(F.lit("Plain Title"))) == "plain-title"


@pytest.mark.parametrize("query,want", [("use a.b or a.b.c", "a.b.c"), ("bare words", None), ("x_y then p.q", "x_y"), ("scaled_dot_product_attention?", "scaled_dot_product_attention")])
def test_symbol(spark, query, want):
    assert one(spark, tx.symbol_in_query(F.lit(query))) == want


def test_exact_api(spark):
    url = F.lit("https://x/docs/generated/torch.nn.functional.relu.html")
    assert one(spark, tx.is_exact_api(F.lit("api"), url, F.lit("relu"))) and one(spark, tx.is_exact_api(F.lit("api"), url, F.lit("torch.nn.functional.relu")))
    assert not one(spark, tx.is_exact_api(F.lit("api"), url, F.lit("elu"))) and not one(spark, tx.is_exact_api(F.lit("guide"), url, F.lit("relu")))
    assert one(spark, tx.symbol_of_url(url)) == "torch.nn.functional.relu" and one(spark, tx.symbol_of_url(F.lit("https://x/a.b.html"))) == ""


def test_english_gate_at_its_borders(spark):
    ok = lambda t: one(spark, tx.looks_english(F.lit(t)))
    assert ok("éé") and not ok("ééé") and ok("é" * 3 + "a" * 27) and not ok("é" * 4 + "a" * 35)


def test_search_terms(spark):
    terms = lambda q: one(spark, tx.search_terms(F.lit(q)))
    assert terms("how is torch.nn.Linear implemented?") == "torch.nn.Linear"
    assert terms("what is it") == "what%20is%20it"
    assert terms(" ".join(f"w{i}" for i in range(30))).count("%20") == 11


def test_indexed_text_order(spark):
    text = tx.indexed_text(F.lit("https://x/docs/torch.add.html"), F.lit("Adds."), F.lit(None).cast("string"), F.array(F.lit("q1"), F.lit("q2")), F.array(F.lit("A"), F.lit("B")), F.lit("body"))
    assert one(spark, text) == "torch.add\nAdds.\nq1 q2\nA > B\nbody"


def test_chunk_key_counts_parts_from_the_second(spark):
    key = lambda p: one(spark, tx.chunk_key(F.lit("u"), F.lit("a"), F.array(F.lit("h")), F.lit(p)))
    assert key(0) == one(spark, F.sha2(F.lit("u#a#h"), 256)) and key(1) == one(spark, F.sha2(F.lit("u#a#h#part1"), 256))


def test_small_helpers(spark, monkeypatch):
    assert one(spark, tx.json_object(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}' and one(spark, tx.json_list(F.lit("none"))) is None
    assert "sk-" not in one(spark, tx.redacted(F.lit("bearer abc and sk-12345678abc")))
    assert one(spark, tx.context_body(F.lit("x" * 3000))).startswith("x" * 2500 + "\n[") and one(spark, tx.context_body(F.lit("x"))) == "x"
    assert one(spark, tx.retry_after(F.lit("1.5"))) == 1.5 and one(spark, tx.retry_after(F.lit("soon"))) is None
    assert one(spark, tx.html_escape(F.lit("<a&'b'>"))) == "&lt;a&amp;&#x27;b&#x27;&gt;"
    assert one(spark, tx.page_path(F.lit("https://h/docs/a/b.html?x=1#y"))) == "docs/a/b.md" and one(spark, tx.page_path(F.lit("https://h/"))) == "index.md"
    monkeypatch.setenv("X_LIMIT", "abc")
    assert env_float("X_LIMIT", 2.0) == 2.0 and env_float("X_NONE", 1.0) == 1.0
    assert embed_dims("small") == 384 and embed_dims("other", 10) == 10
    with pytest.raises(ValueError):
        embed_dims("other")


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("formalize", "formal"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("probate", "probat"), ("rate", "rate")])
def test_stemmer_on_published_examples(word, want):
    assert stem(word) == want


def test_lexemes(spark):
    assert one(spark, lexemes(F.lit("The optimizers of torch.optim are running"))) == ["optim", "torch.optim", "torch", "optim", "run"]
    assert one(spark, lexemes(F.lit("the of"))) == []


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, cosine_distance(a, b)) == 1.0 and one(spark, cosine_distance(a, a)) == 0.0
    assert one(spark, cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, normalized(b)) == [0.0, 1.0]


# chunking


def test_sections_follow_headings():
    body = "intro\n\n# A\ntext a\n## B\ntext b\n### C\n## D [¶](#real \"x\")\nhttps://github.com/pytorch/x/blob/main/f.py\n# E\n####### seven\n"
    got = list(chunking.sections(body))
    assert [g[0] for g in got] == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["A", 'D [¶](#real "x")'], ["E"]]
    assert got[4][2].endswith("/f.py") and got[5][1] == "####### seven"


def test_heading_lines_in_fences_count_as_headings():
    assert len(list(chunking.sections("```\n# comment\n```"))) == 2


def test_parts_keep_fences_whole_and_conserve_text():
    fence = "```\n" + "x = 1\n\n" * 20 + "```"
    text = "a " * 100 + "\n\n" + fence + "\n\n" + "b " * 100
    got = chunking.parts(text, 250)
    assert any(fence in p for p in got) and all(len(p) <= 250 for p in got)
    assert "".join("".join(got).split()) == "".join(text.split())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n`", max_size=60), max_size=12), st.integers(5, 80))
def test_parts_conserve_any_text(blocks, limit):
    text = "\n\n".join(blocks)
    got = chunking.parts(text, limit)
    assert sorted("".join("".join(got).split())) == sorted("".join(text.split()))


def test_cut_lines():
    assert chunking.cut_lines("aaaa\nbbbb\ncc", 6) == ["aaaa", "bbbb", "cc"] or chunking.cut_lines("aaaa\nbbbb\ncc", 6) == ["aaaa", "bbbb\ncc"]
    assert chunking.cut_lines("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.cut_lines("ab\n" + "y" * 12, 10) == ["y" * 10, "ab\nyy"]


def test_titles_and_anchors(spark):
    df = spark.createDataFrame([("https://x/docs/d.html", "d", "l", "h", 'intro\n# A\\_b\ntext\n## D [¶](#real "x")\nmore')], "url string, title string, library string, content_hash string, body string")
    got = chunking.chunk_pages(df).orderBy("ordinal").collect()
    assert [(r.heading_path, r.anchor) for r in got] == [([], ""), (["A_b"], "a-b"), (["A_b", "D"], "real")]


def test_synopsis(spark):
    first = lambda body: one(spark, chunking.synopsis(F.lit(body)))
    body = "# torch.add\n\n*class* torch.add(x)[[source]](https://x)\n:   Adds two tensors of any shape together. More.\n\nParameters"
    assert first(body) == "Adds two tensors of any shape together."
    assert first("Parameters\n\ntorch.f(x, y)\n\n" + "long words " * 60) == ("long words " * 60).strip()[:240]
    assert first("") == ""


def test_window_paths_equal_the_breadcrumbs(spark):
    rng = random.Random(3)
    outlines = [[rng.randint(1, 6) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    rows = [(p, i, lv, f"t{i}") for p, o in enumerate(outlines) for i, lv in enumerate(o)]
    got = {(r.page, r.pos): r.heading_path for r in chunking.heading_paths(spark.createDataFrame(rows, "page int, pos int, level int, title string")).collect()}
    for p, o in enumerate(outlines):
        body = "\n".join(f"{'#' * lv} t{i}\nx" for i, lv in enumerate(o))
        for i, section in enumerate(chunking.sections(body)):
            assert got[(p, i)] == section[0]


def test_greedy_parts_in_the_jvm(spark):
    rng = random.Random(5)
    for _ in range(5):
        ps = ["p" * rng.randint(1, 40) for _ in range(rng.randint(1, 15))]
        assert one(spark, chunking.greedy_parts(F.array(*map(F.lit, ps)), 60)) == (chunking.parts("\n\n".join(ps), 60))


def test_chunk_pages(spark):
    rows = [("https://x/docs/a.html", "A", "core", "h", "# T\n\nAdds all the numbers in a list. Yes.\n\n## Empty\n\n## U\n" + "para\n\n" * 900), ("https://x/tutorials/b.html", "B", "tut", "h", None), ("https://x/c.html", None, None, None, "only text")]
    got = chunking.chunk_pages(spark.createDataFrame(rows, "url string, title string, library string, content_hash string, body string")).collect()
    a = [r for r in got if r.url.endswith("a.html")]
    assert [r.part for r in a] == [0, *range(len(a) - 1)] and a[1].heading_path == ["T", "U"] and all(r.kind == "api" and r.synopsis == "Adds all the numbers in a list." for r in a)
    assert [r.kind for r in got if "c.html" in r.url] == ["guide"] and not [r for r in got if "b.html" in r.url]


# pages


def test_main_content_without_chrome():
    page = "<html><title> T </title><body><nav>menu</nav><div role='main'><h1>Head</h1><script>x</script><p>One <b>two</b> <a href='/u'>three</a></p><ul><li>i<li>j</ul><pre>a\n  b</pre></div></body></html>"
    title, body = html.convert(page)
    assert title == "T" and body.startswith("# Head\n\nOne **two** [three](/u)\n\n* i") and body.endswith("```\na\n  b\n```") and "menu" not in body
    assert html.convert(None) == ("", "") and html.convert("<article>a<footer>b</footer></article>")[1] == "a"
    assert html.convert("<body>x<article class='pytorch-article'>y</article></body>")[1] == "y"
    assert html.convert("<dl><dt>f(x)</dt><dd>Does it.</dd></dl>")[1] == "f(x)\n:   Does it."


def test_redirects(spark):
    stub = '<meta http-equiv="Refresh" content="0; url=../b.html">'
    assert html.redirect_of(stub, "https://x/a/a.html") == "https://x/b.html"
    assert html.redirect_of('<link rel="canonical" href="https://x/a/">', "https://x/a") is None
    assert html.redirect_of('<link rel="canonical" href="/c">', "https://x/a") == "https://x/c"
    pages = [("https://x/a/a.html", stub), ("https://x/b.html", '<meta http-equiv=refresh content="0;url=/c.html">'), ("https://x/c.html", "<p>real</p>"), ("https://x/l.html", '<meta http-equiv=refresh content="0;url=/l.html">'), ("https://x/o.html", '<meta http-equiv=refresh content="0;url=/gone.html">')]
    got = {r.url: r.html for r in html.follow_redirects(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got["https://x/a/a.html"] == "<p>real</p>" and got["https://x/l.html"] == pages[3][1] and got["https://x/o.html"] == pages[4][1]
