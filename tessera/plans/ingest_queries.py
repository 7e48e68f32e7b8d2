"""Queries of sources, pages, chunking, the store and the index build, over data made from the tables.

Files, inventories, sitemaps and pages are written from the tables first and read back by the operators;
the SQL tells what must come back from the tables alone.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from tessera.functions.lexemes import plain_tokens
from tessera.functions.text import chunk_key
from tessera.operators import chunking, html, manifest, retrieval, store
from tessera.plans import build
from tessera.plans.registry import folder, query, table
from tessera.sources import discovery, snapshot


def _text(*parts) -> F.Column:
    """Columns by name and literals, joined; a leading ``=`` marks a literal."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else (F.col(p).cast("string") if isinstance(p, str) else p) for p in parts])


# files


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    body = F.regexp_replace(F.coalesce("html", F.lit("")), "^\n+", "")
    rows = table(spark, sf, "pages").select(_text("=https://example.org/docs/generated/p", "page_id", "=.html").alias("url"), _text('=T: "', "page_id", '="').alias("title"), _text("=lib", F.col("page_id") % 4).alias("library"), body.alias("body"))
    return rows.withColumns({"content_hash": F.sha2("body", 256), "crawled_at": F.lit("2024-01-02")})


@query(
    """SELECT 'https://example.org/docs/generated/p' || page_id || '.html' AS url, 'T: "' || page_id || '"' AS title, 'lib' || (page_id % 4) AS library, sha256(body) AS content_hash, '2024-01-02' AS crawled_at,
CASE WHEN body = '' THEN sha256('') ELSE sha256(body || chr(10)) END AS body_sha256, 'p' || page_id || '.md' AS file
FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '^\n+', '') AS body FROM pages)"""
)
def s1_snapshot_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page files written and scanned again."""
    where = folder(spark, "snapshot")
    snapshot.write_page_files(_pages(spark, sf), where)
    found = snapshot.read_pages(spark, where)
    return found.select("url", "title", "library", "content_hash", "crawled_at", F.sha2("body", 256).alias("body_sha256"), F.substring_index("path", "/", -1).alias("file"))


@query(
    """SELECT round, 'lib' || (page_id % 4) AS library, count(*) AS n_pages, CAST(sum((round = 1 OR page_id % 3 = 0)::INT) AS BIGINT) AS n_changed
FROM pages, (SELECT unnest([1, 2]) AS round) GROUP BY ALL"""
)
def k2_write_changed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Two crawls into one snapshot; a third of the pages changed in between."""
    where, pages = folder(spark, "crawl"), _pages(spark, sf)
    first = snapshot.write_changed_pages(pages, where)
    changed = F.endswith("url", F.lit(".html")) & (F.regexp_extract("url", r"p(\d+)\.html", 1).cast("int") % 3 == 0)
    body = F.when(changed, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    second = snapshot.write_changed_pages(pages.withColumn("body", body).withColumn("content_hash", F.sha2("body", 256)), where)
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))


@query(
    """SELECT trim(regexp_replace(lower('d' || doc_id || '-' || CASE WHEN doc_id % 2 = 0 THEN 'Sec_' || lang ELSE 'sec' END || '-' || (doc_id % 5)), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS path,
sha256(coalesce(text, '') || chr(10)) AS content_sha256 FROM documents"""
)
def k3_unit_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(_text("=https://x.org/", "source", "=/d", "doc_id", "=.html").alias("url"), F.when(F.col("doc_id") % 2 == 0, _text("=Sec_", "lang")).otherwise("").alias("anchor"), (F.col("doc_id") % 5).alias("ordinal"), F.coalesce("text", F.lit("")).alias("content"))
    found = snapshot.unit_files(docs)
    return found.select("path", F.sha2(F.element_at(F.split("text", "\n---\n\n", 2), 2), 256).alias("content_sha256"))


def _lines(rows: DataFrame, where: str, order: str) -> str:
    """JSON lines in an order, in one file, as a run appends them."""
    rows.coalesce(1).sortWithinPartitions(order).drop(order).write.json(where)
    return where


@query("SELECT source AS url, max_by(lang || '-' || doc_id, doc_id) AS gloss FROM documents GROUP BY source")
def s3_glosses(spark: SparkSession, sf: str) -> DataFrame:
    """Every page has many lines; the last one counts."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("url"), _text("lang", "=-", "doc_id").alias("gloss"))
    return snapshot.read_glosses(spark, _lines(rows, folder(spark, "glosses"), "doc_id"))


@query("SELECT source AS url, max_by(lang || '?|' || doc_id || '?', doc_id) AS questions FROM documents GROUP BY source")
def s4_page_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("url"), F.array(_text("lang", "=?"), _text("doc_id", "=?")).alias("questions"))
    found = snapshot.read_questions(spark, _lines(rows, folder(spark, "questions"), "doc_id"))
    return found.select("url", F.array_join("questions", "|").alias("questions"))


@query(
    """SELECT 'inline' AS kind, 'b' || item_id AS id, text AS question, CAST(1 AS INT) AS n_groups FROM benchmark
UNION ALL SELECT 'sidecar', 'b' || item_id, text, CASE WHEN item_id % 2 = 0 THEN 2 END FROM benchmark"""
)
def s5_question_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Expectations in the set itself, and in a second file that has them for every other question."""
    base = table(spark, sf, "benchmark").select("item_id", _text("=b", "item_id").alias("id"), F.lit("t").alias("type"), F.col("text").alias("question"))
    inline, plain, sidecar = (folder(spark, x) for x in ("inline", "plain", "sidecar"))
    base.withColumn("expected", F.array(F.array("type"))).drop("item_id").write.json(inline)
    base.drop("item_id").write.json(plain)
    base.where("item_id % 2 = 0").select("id", F.array(F.array("id"), F.array("type")).alias("expected")).write.json(sidecar)
    size = F.when(F.col("expected").isNotNull(), F.size("expected")).alias("n_groups")
    first = snapshot.read_question_set(spark, inline).select(F.lit("inline").alias("kind"), "id", "question", size)
    return first.union(snapshot.read_question_set(spark, plain, sidecar).select(F.lit("sidecar"), "id", "question", size))


@query(
    """SELECT 'b' || item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'again' ELSE 'kept' END AS state, CASE WHEN item_id % 3 <> 0 THEN 'a' || item_id END AS answer FROM benchmark"""
)
def s7_resumed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier results with an answer are kept, questions whose result is an error are asked again."""
    base = table(spark, sf, "benchmark").select(_text("=b", "item_id").alias("id"), F.when(F.col("item_id") % 3 != 0, _text("=a", "item_id")).alias("answer"), F.when(F.col("item_id") % 3 == 0, "boom").alias("error"))
    where = folder(spark, "results")
    snapshot.write_results(base, where)
    kept = snapshot.read_answered(spark, where, "id string, answer string, error string")
    again = manifest.remaining(base.select("id"), kept, "id")
    return kept.select("id", F.lit("kept").alias("state"), "answer").union(again.select("id", F.lit("again"), F.lit(None).cast("string")))


@query("SELECT DISTINCT source || '/' || lang AS url, (source || '/' || lang) IN (SELECT source || '/' || lang FROM documents WHERE doc_id % 4 = 0) AS covered FROM documents")
def s8_covered_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Urls that a results file covers, and those that are left."""
    urls = table(spark, sf, "documents").select("doc_id", _text("source", "=/", "lang").alias("url"))
    where = folder(spark, "covered")
    snapshot.write_results(urls.where("doc_id % 4 = 0").select("url"), where)
    done = snapshot.read_urls(spark, where)
    left = manifest.remaining(urls.select("url").distinct(), done)
    return done.select("url", F.lit(True).alias("covered")).union(left.select("url", F.lit(False)))


@query("SELECT 'appended' AS state, conv_id, turn, sha256(coalesce(text, '')) AS text_sha256 FROM conversations UNION ALL SELECT 'overwritten', conv_id, turn, sha256(coalesce(text, '')) FROM conversations WHERE role = 'user'")
def k9_results_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches appended to one file set, and another one overwritten by its last batch."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    grown, last = folder(spark, "appended"), folder(spark, "overwritten")
    for batch in (rows.where("role <> 'user'"), rows.where("role = 'user'")):
        snapshot.write_results(batch, grown, append=True)
        snapshot.write_results(batch, last)
    read = lambda where, name: spark.read.schema(rows.schema).json(where).select(F.lit(name).alias("state"), "conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))
    return read(grown, "appended").union(read(last, "overwritten"))


@query("SELECT source AS url, min_by(lang, doc_id) AS kind, greatest(count(*) FILTER (WHERE doc_id % 4 <> 0), 1) AS n_chunks, coalesce(array_to_string(list_sort(list_distinct(list(lang) FILTER (WHERE doc_id % 4 <> 0))), '|'), '') AS headings FROM documents GROUP BY source")
def k11_manifest_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup of pages written as JSON lines and read again."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("source").alias("url"), F.format_string("%012d", "doc_id").alias("chunk_key"), F.col("lang").alias("kind"), F.lit("x").alias("library"), F.lit("t").alias("page_title"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).otherwise("").alias("heading_path"))
    where = folder(spark, "manifest")
    manifest.dump(manifest.page_rollup(rows), where, "library", "kind", "url")
    found = spark.read.schema("url string, kind string, n_chunks long, headings array<string>").json(where)
    return found.select("url", "kind", "n_chunks", F.array_join("headings", "|").alias("headings"))


# discovery

_HEAD = b"# Sphinx inventory version 2\n# Project: x\n# Version: 1\n# The remainder of this file is compressed using zlib.\n"


@pandas_udf(BinaryType())
def _inventory(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: _HEAD + zlib.compress(x.encode()))


@query(
    """SELECT source AS library, lang || '.item' || doc_id AS name, role, 'https://x.org/' || source || '/api/p' || doc_id || '.html' AS page_url, lang || '.item' || doc_id AS anchor
FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'py:class' WHEN 1 THEN 'py:function' WHEN 2 THEN 'std:label' ELSE 'std:doc' END AS role FROM documents) WHERE role <> 'std:label' AND doc_id % 5 <> 4"""
)
def s13_inventories(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed inventories, one a library, read; objects that have pages of their own stay."""
    role = F.element_at(F.array(*map(F.lit, ("py:class", "py:function", "std:label", "std:doc"))), (F.col("doc_id") % 4 + 1).cast("int"))
    line = _text("lang", "=.item", "doc_id", "= ", role, "= 1 api/p", "doc_id", F.when(F.col("doc_id") % 5 == 4, "#$").otherwise(".html#$"), "= -")
    lines = table(spark, sf, "documents").groupBy("source").agg(F.array_join(F.array_append(F.collect_list(line), F.lit("odd")), "\n").alias("lines"))
    files = lines.select(F.col("source").alias("library"), _text("=https://x.org/", "source", "=/").alias("base"), _inventory("lines").alias("content"))
    return manifest.documented(discovery.parse_inventories(files)).select("library", "name", "role", "page_url", "anchor")


_NS = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


@query(
    """WITH m AS (SELECT source AS library, 'https://' || CASE WHEN doc_id % 7 = 0 THEN 'else.org/' ELSE 'x.org/' || source || '/' END || 'p' || doc_id || '.html' AS url FROM documents),
i AS (SELECT source AS library, 'https://x.org/' || source || '/api/p' || doc_id || '.html' AS url FROM documents WHERE doc_id % 3 = 0)
SELECT 'sitemap' AS kind, * FROM m UNION ALL SELECT 'discovered', * FROM (SELECT * FROM m WHERE starts_with(url, 'https://x.org/' || library || '/') UNION SELECT * FROM i)"""
)
def s14_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemaps of some libraries list pages, of the others two more sitemaps; with inventories they give the corpus."""
    place = F.when(F.col("doc_id") % 7 == 0, "else.org/").otherwise(_text("=x.org/", "source", "=/"))
    docs = table(spark, sf, "documents").select("doc_id", "source", _text("=https://", place, "=p", "doc_id", "=.html").alias("url"), (F.crc32("source") % 2).alias("deep"), (F.col("doc_id") % 2).alias("half"))
    entry = _text("=<url><loc>\n ", "url", '= </loc><image:image xmlns:image="i"><image:loc>https://img/x.png</image:loc></image:image></url>')
    urlset = F.concat(F.lit(f"<urlset{_NS}>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml")
    flat = docs.where("deep = 0").groupBy(F.col("source").alias("library")).agg(urlset)
    nested = docs.where("deep = 1")
    maps = nested.groupBy(_text("=https://x.org/", "source", "=/map", "half", "=.xml").alias("url")).agg(urlset)
    entries = F.concat(F.lit(f"<sitemapindex{_NS}>"), F.array_join(F.collect_set(_text("=<sitemap><loc>https://x.org/", "source", "=/map", "half", "=.xml</loc></sitemap>")), ""), F.lit("</sitemapindex>")).alias("xml")
    index = nested.groupBy(F.col("source").alias("library")).agg(entries)
    pages = discovery.sitemap_pages(flat.union(index), maps)
    inventory = docs.select(F.col("source").alias("library"), _text("=https://x.org/", "source", "=/api/p", "doc_id", F.when(F.col("doc_id") % 3 == 0, ".html").otherwise("")).alias("page_url"))
    seeds = docs.select(F.col("source").alias("library"), _text("=https://x.org/", "source", "=/").alias("base")).distinct()
    found = discovery.discovered(inventory, pages, seeds)
    return pages.select(F.lit("sitemap").alias("kind"), "library", "url").union(found.select(F.lit("discovered"), "library", "url"))


@query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '<meta http-equiv="Refresh" content="0; url=p' || (doc_id + 1) || '.html">' WHEN 2 THEN '<link rel="canonical" href="/p' || (doc_id + 1) || '.html">'
  WHEN 0 THEN '<link rel="canonical" href="https://x.org/p' || doc_id || '.html/"><p>own ' || doc_id || '</p>' ELSE '<p>real ' || doc_id || '</p>' END AS html FROM documents)
SELECT 'https://x.org/p' || a.doc_id || '.html' AS url, CASE WHEN a.doc_id % 4 IN (1, 2) THEN 'https://x.org/p' || (a.doc_id + 1) || '.html' END AS target,
CASE a.doc_id % 4 WHEN 1 THEN coalesce(c.html, b.html, a.html) WHEN 2 THEN coalesce(b.html, a.html) ELSE a.html END AS final
FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id + 1 LEFT JOIN p c ON c.doc_id = a.doc_id + 2 AND b.doc_id IS NOT NULL"""
)
def p16_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """Refreshes and canonical links to the next page; chains of up to two hops."""
    stub = (
        F.when(F.col("doc_id") % 4 == 1, _text('=<meta http-equiv="Refresh" content="0; url=p', F.col("doc_id") + 1, '=.html">'))
        .when(F.col("doc_id") % 4 == 2, _text('=<link rel="canonical" href="/p', F.col("doc_id") + 1, '=.html">'))
        .when(F.col("doc_id") % 4 == 0, _text('=<link rel="canonical" href="https://x.org/p', "doc_id", '=.html/"><p>own ', "doc_id", "=</p>"))
        .otherwise(_text("=<p>real ", "doc_id", "=</p>"))
    )
    pages = table(spark, sf, "documents").select(_text("=https://x.org/p", "doc_id", "=.html").alias("url"), stub.alias("html"))
    final = html.follow_redirects(pages).withColumnRenamed("html", "final")
    return pages.select("url", html.redirect_target("html", "url").alias("target")).join(final, "url")


_PLACE = "(SELECT doc_id, 'https://x.org/p' || doc_id || '.html' AS url FROM documents)"


@query(
    f"""SELECT url, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN NULL ELSE 'page ' || doc_id || chr(65533) END AS html,
CASE WHEN doc_id % 7 = 0 THEN 'Permanent' WHEN doc_id % 11 = 0 THEN 'OSError' END AS error, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 5 = 1 THEN 3 ELSE 0 END AS waited FROM {_PLACE}"""
)
def s17_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """A source that fails for good, always, twice at first, or never; ``waited`` adds up the pauses of 1 and 2 seconds."""
    tries: dict[str, int] = {}
    waits = [0.0]

    def get(url: str) -> bytes:
        n, seen = int(url.split("/p")[1][:-5]), tries.get(url, 0)
        if not seen:
            waits[0] = 0.0
        tries[url] = seen + 1
        if n % 7 == 0:
            raise discovery.Permanent(url)
        if n % 11 == 0 or (n % 5 == 1 and seen < 2):
            raise OSError("reset")
        return f"page {n}".encode() + b"\xff" + (f"|{int(waits[0])}".encode())

    def wait(seconds: float) -> None:
        waits[0] += seconds

    urls = table(spark, sf, "documents").select(F.lit("x").alias("library"), _text("=https://x.org/p", "doc_id", "=.html").alias("url"))
    found = discovery.fetch_pages(urls, get, 0.0, wait)
    n = F.regexp_extract("url", r"p(\d+)\.html", 1).cast("long")
    waited = F.when(F.col("html").isNotNull(), F.substring_index("html", "|", -1).cast("int")).when(n % 7 == 0, 0).otherwise(3)
    return found.select("url", F.substring_index("html", "|", 1).alias("html"), F.substring_index("error", ":", 1).alias("error"), waited.alias("waited"))


@query(
    f"""SELECT url, CASE WHEN doc_id % 3 = 1 THEN 'own ' || doc_id WHEN doc_id % 3 = 2 THEN 'cached ' || doc_id ELSE '# Live ' || doc_id || chr(10) || chr(10) || 'read now' END AS body FROM {_PLACE} WHERE doc_id % 21 <> 0"""
)
def s20_read_through(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the snapshot, of a cache, and read now; some of the last kind cannot be read."""
    urls = table(spark, sf, "documents").select("doc_id", F.lit("x").alias("library"), _text("=https://x.org/p", "doc_id", "=.html").alias("url"))
    held = lambda r, word: urls.where(F.col("doc_id") % 3 == r).select("url", F.lit("t").alias("title"), "library", F.lit("h").alias("content_hash"), F.lit("2024-01-01").alias("crawled_at"), _text(f"={word} ", "doc_id").alias("body"))

    def get(url: str) -> bytes:
        n = url.split("/p")[1][:-5]
        if int(n) % 21 == 0:
            raise discovery.Permanent(url)
        return f"<html><body><nav>menu</nav><main><h1>Live {n}</h1><p>read now</p></main></body></html>".encode()

    cache = held(2, "cached").unionByName(held(1, "stale"))
    return discovery.read_through(urls.select("library", "url"), held(1, "own"), cache, get=get, delay=0.0).select("url", "body")


@query(
    f"""SELECT url, h.i AS ordinal, CASE h.i WHEN 0 THEN 'Live ' || doc_id ELSE 'Live ' || doc_id || ' > More' END AS heading_path, CASE h.i WHEN 0 THEN 'read now' ELSE 'and **then** ' || doc_id END AS content
FROM {_PLACE}, (SELECT unnest([0, 1]) AS i) h"""
)
def s21_live_units(spark: SparkSession, sf: str) -> DataFrame:
    """Pages read now, behind one redirect, and chunked as the build does it."""

    def get(url: str) -> bytes:
        n = url.split("/p")[1][:-5]
        if not n.startswith("-"):
            return f'<meta http-equiv="refresh" content="0;url=/p-{n}.html">'.encode()
        return f"<article><h1>Live {n[1:]}</h1><p>read now</p><h2>More</h2><p>and <b>then</b> {n[1:]}</p></article>".encode()

    urls = table(spark, sf, "documents").select(F.lit("x").alias("library"), _text("=https://x.org/p", "doc_id", "=.html").alias("url"))
    units = chunking.chunk_pages(discovery.live_pages(urls, get, 0.0))
    return units.select("url", "ordinal", F.array_join("heading_path", " > ").alias("heading_path"), "content")


# pages and chunks


@query(
    """SELECT doc_id, 'T ' || doc_id AS title, '# Head ' || doc_id || chr(10) || chr(10) || 'One **two** [three](/u' || doc_id || ') & \\*star\\*' || chr(10) || chr(10) || '* first' || chr(10) || '* second' || chr(10) || chr(10)
|| '```' || chr(10) || 'a' || chr(10) || '  b ' || doc_id || chr(10) || '```' || chr(10) || chr(10) || '## Sub' || chr(10) || chr(10) || 'under\\_score `c_d`' AS body FROM documents"""
)
def p1_made_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose content lies in each of the five places, with chrome around and inside, as markdown."""
    places = [('<article class="pytorch-article x">', "</article>"), ('<div role="main">', "</div>"), ("<main>", "</main>"), ("<article>", "</article>"), ("", "")]
    pick = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in places]), (F.col("doc_id") % 5 + 1).cast("int"))
    inner = _text("=<h1>Head ", "doc_id", '=</h1><script>var x = "<p>";</script><p>One <b>two</b>\n <a href="/u', "doc_id", '=">three</a> &amp; *star*</p><ul><li>first</li><li>second</li></ul><pre>a\n  b ', "doc_id", "=</pre><h2>Sub</h2><p>under_score <code>c_d</code></p><aside>ad</aside>")
    page = _text("=<html><head><title> T ", "doc_id", "= </title><style>p{}</style></head><body><header>h</header><nav>menu</nav>", pick(0), inner, pick(1), "=<footer>foot</footer></body></html>")
    raw = table(spark, sf, "documents").select("doc_id", _text("=u", "doc_id").alias("url"), page.alias("html"))
    clean = html.clean_pages(raw, F.lit("x"))
    return clean.join(raw.select("doc_id", "url"), "url").select("doc_id", "title", "body")


_UNITS = """WITH d AS (SELECT doc_id AS i, 'Title_' || doc_id AS t, CASE doc_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'tutorial' ELSE 'guide' END AS kind FROM documents),
u AS (
  SELECT i, 0 AS s, 0 AS part, '' AS path, '' AS anchor, 'Intro ' || i || '.' AS content, '' AS source FROM d
  UNION ALL SELECT i, 1, 0, t, 'top' || i, 'Adds item ' || i || ' to the list of all things. More text.', '' FROM d
  UNION ALL SELECT i, 2, p, t || ' > Long ' || i, 'long-' || i, array_to_string(list_transform(range(least(2, i % 6 - 2 * p)), lambda x: repeat('x', 700)), chr(10) || chr(10)), '' FROM d, (SELECT unnest(range(3)) AS p) WHERE 2 * p < i % 6
  UNION ALL SELECT i, 3, 0, t || ' > Long ' || i || ' > Code', 'code', '```' || chr(10) || 'x = ' || i || chr(10) || chr(10) || 'y' || chr(10) || '```' || chr(10) || 'https://github.com/pytorch/x/blob/main/f' || i || '.py', 'https://github.com/pytorch/x/blob/main/f' || i || '.py' FROM d
  UNION ALL SELECT i, 4, p, 'Wide', 'wide', repeat('w', least(2000, 2000 * (i % 3) + 500 - 2000 * p)), '' FROM d, (SELECT unnest(range(3)) AS p) WHERE p <= i % 3
)
SELECT i AS doc_id, row_number() OVER (PARTITION BY i ORDER BY s, part) - 1 AS ordinal, part, path AS heading_path, anchor, kind, source AS source_link, CASE WHEN kind = 'api' THEN 'Adds item ' || i || ' to the list of all things.' ELSE '' END AS synopsis, sha256(content) AS content_sha256
FROM u JOIN d USING (i)"""


@query(_UNITS)
def p12_made_units(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a preamble, a permalink, an empty and a long section, a fence, and lines beyond the limit."""
    i = F.col("doc_id")
    folder_ = F.element_at(F.array(F.lit("docs"), F.lit("tutorials"), F.lit("other")), (i % 3 + 1).cast("int"))
    body = _text(
        "=Intro ", "doc_id", "=.\n\n# Title\\_", "doc_id", "= [#](#top", "doc_id", '= "Permalink to this heading")\n\nAdds item ', "doc_id", "= to the list of all things. More text.\n\n## Empty\n\n## Long ", "doc_id", "=\n",
        F.array_join(F.array_repeat(F.lit("x" * 700), (i % 6).cast("int")), "\n\n"),
        "=\n\n### Code\n```\nx = ", "doc_id", "=\n\ny\n```\nhttps://github.com/pytorch/x/blob/main/f", "doc_id", "=.py\n# Wide\n", F.repeat(F.lit("w"), (i % 3 * 2000 + 500).cast("int")),
    )
    pages = table(spark, sf, "documents").select(_text("=https://x.org/", folder_, "=/p", "doc_id", "=.html").alias("url"), F.lit("t").alias("title"), F.lit("x").alias("library"), F.lit("h").alias("content_hash"), body.alias("body"))
    units = chunking.chunk_pages(pages)
    doc = F.regexp_extract("url", r"p(\d+)\.html", 1).cast("long").alias("doc_id")
    return units.select(doc, F.col("ordinal").cast("long").alias("ordinal"), F.col("part").cast("long").alias("part"), F.array_join("heading_path", " > ").alias("heading_path"), "anchor", "kind", "source_link", "synopsis", F.sha2("content", 256).alias("content_sha256"))


@query(
    """WITH h AS (SELECT source AS page, doc_id AS pos, 1 + (doc_id * 7 + doc_id // 3) % 5 AS level, 'h' || doc_id AS title FROM documents),
a AS (SELECT x.page, x.pos, y.pos AS up, y.title FROM h x JOIN h y ON y.page = x.page AND y.pos < x.pos AND y.level < x.level
      WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.page = x.page AND z.pos > y.pos AND z.pos < x.pos AND z.level <= y.level))
SELECT h.page, h.pos, array_to_string(list_append(coalesce(list(a.title ORDER BY a.up) FILTER (WHERE a.up IS NOT NULL), []), any_value(h.title)), ' > ') AS path FROM h LEFT JOIN a ON a.page = h.page AND a.pos = h.pos GROUP BY h.page, h.pos"""
)
def w5_heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    """An ancestor is an earlier, higher heading that no heading of its level or above follows before the row."""
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(F.col("source").alias("page"), i.alias("pos"), (1 + (i * 7 + F.floor(i / 3)) % 5).alias("level"), _text("=h", "doc_id").alias("title"))
    return chunking.heading_paths(rows).select("page", "pos", F.array_join("heading_path", " > ").alias("path"))


@query(
    """SELECT url, excerpt FROM (SELECT *, row_number() OVER (ORDER BY (NOT contains(url, '/docs/'))::INT, url) AS n FROM (
  SELECT 'https://x.org/' || CASE doc_id % 3 WHEN 0 THEN 'docs/' WHEN 1 THEN 'lib/generated/' ELSE 'tutorials/' END || 'p' || doc_id || '.html' AS url, doc_id % 3 AS k,
         trim(regexp_replace(substr(text, 1, 1500), '\\s+', ' ', 'g')) AS excerpt FROM documents) WHERE k < 2) WHERE n <= 40"""
)
def s12_api_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The first forty API pages, the core's first, with a flat excerpt."""
    place = F.element_at(F.array(F.lit("docs/"), F.lit("lib/generated/"), F.lit("tutorials/")), (F.col("doc_id") % 3 + 1).cast("int"))
    pages = table(spark, sf, "documents").select(_text("=https://x.org/", place, "=p", "doc_id", "=.html").alias("url"), F.col("text").alias("body"))
    return manifest.first_rows(manifest.api_excerpts(pages), 40, F.when(F.col("url").contains("/docs/"), 0).otherwise(1), "url")


@query("SELECT CAST(count(*) AS BIGINT) AS pages, CAST(sum(length('[0] u' || doc_id || chr(10) || coalesce(text, '')) + 2) AS BIGINT) AS chars, true AS bounded FROM documents")
def p24_batch_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Where batches end depends on the partitions; that each page is in one numbered block of at most eight does not."""
    pages = table(spark, sf, "documents").select(_text("=u", "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("excerpt"))
    found = chunking.batch_prompts(pages, 8, ["url"])
    return found.agg(F.sum("n_pages").alias("pages"), F.sum(F.char_length("prompt") + 2).alias("chars"), (F.max("n_pages") <= 8).alias("bounded"))


# store and build


def _chunks(spark: SparkSession, sf: str, content) -> DataFrame:
    """Rows of the chunk table, one a document."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")
    own = {"chunk_key": _text("=k", "doc_id"), "url": _text("=u", F.col("doc_id") % 97), "content": content, "content_hash": F.sha2(content, 256), "part": F.lit(0), "embedding": F.array(F.char_length("text").cast("float"), F.lit(1.0).cast("float")), "lexemes": F.array("lang"), "ordinal": F.lit(0), "library": F.col("source")}
    return docs.select("doc_id", *[own.get(c, F.lit("")).alias(c) for c in store.COLUMNS])


def _with(rows: DataFrame, condition: str, mark: str) -> DataFrame:
    more = F.concat("content", F.lit(mark))
    return rows.where(condition).withColumn("content_hash", F.sha2(more, 256)).withColumn("content", more).withColumn("url", F.lit("elsewhere"))


@query(
    """SELECT 'k' || doc_id AS chunk_key, 'u' || (doc_id % 97) AS url, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '?' WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS content_sha256 FROM documents WHERE doc_id % 11 <> 0"""
)
def k5_store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A store written, then a seventh of the rows upserted (their url stays), a fifth healed, an eleventh deleted."""
    rows = _chunks(spark, sf, F.col("text"))
    at = store.IndexStore(spark, folder(spark, "store"), width=2, buckets=4)
    at.replace(rows.drop("doc_id"))
    at.upsert(_with(rows, "doc_id % 7 = 0", "!"))
    at.heal(_with(rows, "doc_id % 5 = 0", "?"))
    at.delete(rows.where("doc_id % 11 = 0"))
    return at.chunks().select("chunk_key", "url", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT 'k' || doc_id AS chunk_key, 0 AS part, '' AS content, 0 AS n_lexemes FROM documents")
def k13_later_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Rows from before a part, content and lexemes were kept."""
    at = store.IndexStore(spark, folder(spark, "old"), buckets=4)
    at._commit("chunks", 0, at._write(_chunks(spark, sf, F.col("text")).drop("doc_id", "part", "content", "lexemes")))
    return at.chunks().select("chunk_key", "part", "content", F.size("lexemes").alias("n_lexemes"))


@query("SELECT * FROM (SELECT 2 AS width, (SELECT count(*) FROM documents) AS chunks, true AS probe, '2' AS value UNION ALL SELECT 3, 0, true, '2')")
def k12_store_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of another width read as an empty table; meta values and the probe do not mind."""
    where = folder(spark, "widths")
    first = store.IndexStore(spark, where, width=2)
    first.replace(_chunks(spark, sf, F.col("text")).drop("doc_id"))
    first.set_meta("a", "1")
    first.set_meta("b", "x")
    first.set_meta("a", "2")
    rows = [(w, at.chunks().count(), at.probe(), at.get_meta("a")) for w, at in ((2, first), (3, store.IndexStore(spark, where, width=3)))]
    return spark.createDataFrame(rows, "width int, chunks long, probe boolean, value string")


@query("SELECT r_name AS key, count(n_nationkey)::VARCHAR AS value FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def s22_meta(spark: SparkSession, sf: str) -> DataFrame:
    """How many nations each region has as meta values, each set twice and read back by its key."""
    at = store.IndexStore(spark, folder(spark, "meta"))
    regions, nations = table(spark, sf, "region"), table(spark, sf, "nation")
    rows = regions.join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n")).collect()  # a row a region
    for r in rows:
        at.set_meta(r.r_name, "-")
        at.set_meta(r.r_name, str(r.n))
    found = [(k, at.get_meta(k)) for k in (*(r.r_name for r in rows), "none")]
    return spark.createDataFrame([r for r in found if r[1] is not None], "key string, value string")


def _units(spark: SparkSession, sf: str, mark=None) -> DataFrame:
    docs = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    content = text if mark is None else F.when(mark, F.concat(text, F.lit("!"))).otherwise(text)
    return docs.select(
        "doc_id", _text("=https://x.org/docs/", "source", "=.html").alias("url"), _text("=a", "doc_id").alias("anchor"), F.lit("t").alias("page_title"), F.array("lang", _text("=h", "doc_id")).alias("heading_path"), F.col("source").alias("library"), F.lit("api").alias("kind"),
        F.lit("").alias("source_link"), F.sha2(content, 256).alias("content_hash"), F.lit(0).alias("part"), F.left(F.col("lang"), F.lit(1)).alias("synopsis"), content.alias("content"), F.col("doc_id").cast("int").alias("ordinal"),
    )


def _enrichment(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    by = table(spark, sf, "documents").groupBy(_text("=https://x.org/docs/", "source", "=.html").alias("url")).agg(F.count("*").alias("n"))
    return by.select("url", _text("=gloss ", "n").alias("gloss")), by.where("n % 2 = 0").select("url", F.array(_text("=q", "n"), F.lit("why")).alias("questions"))


def _embed(rows: DataFrame) -> DataFrame:
    """A model's place: the length of what it sees, and one."""
    return rows.select("chunk_key", F.array(F.char_length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


def _letter_counter():
    """A model's place: how many of each of four letters a text has, as a matrix of floats."""
    import numpy as np

    return lambda texts: np.array([[t.count(x) for x in "aeio"] for t in texts], np.float32)


@query(
    """SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS chunk_key, array_to_string(list_transform(['a', 'e', 'i', 'o'], lambda x: length(t) - length(replace(t, x, ''))), ',') AS counts
FROM (SELECT doc_id, left(coalesce(text, ''), 2000) AS t FROM documents)"""
)
def h1_batch_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows whose vectors come from a batch model in the map that makes the rows."""
    docs = table(spark, sf, "documents")
    key = F.sha2(F.col("doc_id").cast("string"), 256)
    text = F.coalesce("text", F.lit(""))
    none = F.lit("")
    units = docs.select(
        key.alias("chunk_key"), F.col("doc_id").cast("int").alias("ordinal"), _text("=u", "doc_id").alias("url"), none.alias("anchor"), F.array(F.lit("h")).alias("heading_path"), F.lit(0).alias("part"), F.lit("guide").alias("kind"),
        F.lit("core").alias("library"), none.alias("page_title"), none.alias("source_link"), none.alias("content_hash"), none.alias("synopsis"), text.alias("content"), text.alias("text"),
    )
    rows = build.index_rows(units, build.BatchModel(_letter_counter), lambda c: plain_tokens(c), "v1")
    return rows.select(F.col("ordinal").cast("long").alias("doc_id"), "chunk_key", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("counts"))


_INDEXED = """e AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, left(lang, 1) || chr(10) || 'gloss ' || n || chr(10) || CASE WHEN n % 2 = 0 THEN 'q' || n || ' why' || chr(10) ELSE '' END || lang || ' > h' || doc_id || chr(10) AS head,
      sha256('https://x.org/docs/' || source || '.html#a' || doc_id || '#' || lang || ' > h' || doc_id) AS chunk_key FROM documents JOIN e USING (source))"""


@query(f"WITH {_INDEXED} SELECT chunk_key, sha256(head || text) AS text_sha256 FROM t")
def p15_indexed_text(spark: SparkSession, sf: str) -> DataFrame:
    """What is embedded and searched: synopsis, gloss, questions, headings, body, joined from three tables."""
    found = build.units_with_text(_units(spark, sf), *_enrichment(spark, sf))
    return found.select("chunk_key", F.sha2("text", 256).alias("text_sha256"))


@query(
    f"""WITH {_INDEXED}, n AS (SELECT *, text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS now FROM t WHERE doc_id % 13 <> 0)
SELECT chunk_key, sha256(now) AS content_hash, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'v2' ELSE 'v1' END AS index_version, sha256(now) AS content_sha256, CAST(least(2000, length(head || now)) AS FLOAT) AS seen, len(regexp_extract_all(lower(head || now), '[a-z]+')) AS n_lexemes FROM n"""
)
def r4_build_index(spark: SparkSession, sf: str) -> DataFrame:
    """Two builds: between them a seventh of the pages changed, a thirteenth went and an eleventh came."""
    at = store.IndexStore(spark, folder(spark, "build"), width=2, buckets=4)
    glosses, questions = _enrichment(spark, sf)
    _two_builds(spark, sf, at, glosses, questions)
    return at.chunks().select("chunk_key", "content_hash", "index_version", F.sha2("content", 256).alias("content_sha256"), F.get("embedding", 0).alias("seen"), F.size("lexemes").alias("n_lexemes"))


def _two_builds(spark: SparkSession, sf: str, at: store.IndexStore, glosses: DataFrame | None = None, questions: DataFrame | None = None) -> list[dict[str, int]]:
    lexemes = lambda c: plain_tokens(c)
    first = build.build_index(at, _units(spark, sf).where("doc_id % 11 <> 0"), _embed, lexemes, "v1", "r1", glosses, questions, batch_rows=300)
    second = build.build_index(at, _units(spark, sf, F.col("doc_id") % 7 == 0).where("doc_id % 13 <> 0"), _embed, lexemes, "v2", "r1", glosses, questions)
    return [first, second]


@query(
    """WITH d AS (SELECT doc_id, doc_id % 7 = 0 AS c, doc_id % 11 = 0 AS n, doc_id % 13 = 0 AS g FROM documents)
SELECT 1 AS build, count(*) AS snapshot_chunks, count(*) AS embedded, 0 AS purged, count(*) AS total FROM d WHERE NOT n
UNION ALL SELECT 2, count(*) FILTER (WHERE NOT g), count(*) FILTER (WHERE NOT g AND (c OR n)), count(*) FILTER (WHERE g AND NOT n), count(*) FILTER (WHERE NOT g) FROM d"""
)
def r4_build_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = _two_builds(spark, sf, store.IndexStore(spark, folder(spark, "counts"), width=2, buckets=4))
    names = ("snapshot_chunks", "embedded", "purged", "total")
    return spark.createDataFrame([(i, *(r[n] for n in names)) for i, r in enumerate(found, 1)], "build int, " + ", ".join(f"{n} long" for n in names))


@query(
    """WITH d AS (SELECT doc_id % 101 = 0 AS changed FROM documents), n AS (SELECT count(*) AS all_rows, count(*) FILTER (WHERE changed) AS few FROM d)
SELECT 1 AS build, all_rows AS embedded, 0 AS purged, true AS touched, false AS beyond, all_rows AS total FROM n
UNION ALL SELECT 2, 0, 0, false, false, all_rows FROM n
UNION ALL SELECT 3, few, 0, few > 0, false, all_rows FROM n
UNION ALL SELECT 4, 0, few, few > 0, false, all_rows - few FROM n"""
)
def r4_rewritten_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Four builds: of everything, of nothing new, of one page in a hundred changed, of those gone.

    ``touched`` tells whether any bucket got a layer, ``beyond`` whether one did without a changed key in it
    or a bucket's other files were replaced.
    """
    at = store.IndexStore(spark, folder(spark, "layers"), width=2, buckets=64)
    few, out, before = F.col("doc_id") % 101 == 0, [], {}
    hit = {r[0] for r in _units(spark, sf).where(few).select(F.pmod(F.xxhash64(chunk_key(F.col("url"), F.col("anchor"), F.col("heading_path"), F.col("part"))), F.lit(64)).cast("int")).distinct().collect()}
    for i, units in enumerate((_units(spark, sf), _units(spark, sf), _units(spark, sf, few), _units(spark, sf, few).where(~few)), 1):
        did = build.build_index(at, units, _embed, lambda c: plain_tokens(c), "v1", "r")
        now = at._current("chunks").layers
        changed = {b for b in now.keys() | before.keys() if now.get(b) != before.get(b)}
        beyond = i > 1 and not changed <= hit or len(changed) != at.written
        out.append((i, did["embedded"], did["purged"], bool(changed), beyond, at.chunks().count()))
        before = now
    return spark.createDataFrame(out, "build int, embedded long, purged long, touched boolean, beyond boolean, total long")


@query(
    """SELECT 'conv/' || conv_id AS url, CASE WHEN length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) > 1500 THEN string_agg('turn ' || turn || ' ' || role, chr(10) ORDER BY turn) ELSE coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') END AS text FROM conversations GROUP BY conv_id"""
)
def p23_stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as pages of a chunk a turn, stored and read back in order; long ones as the outline of their headings."""
    rows = table(spark, sf, "conversations")
    own = {"chunk_key": F.sha2(F.concat_ws("#", "conv_id", "turn"), 256), "url": F.concat(F.lit("conv/"), "conv_id"), "heading_path": F.concat_ws(" ", F.lit("turn"), "turn", "role"), "content": F.coalesce("text", F.lit("")), "ordinal": F.col("turn"), "part": F.lit(0), "embedding": F.array(F.lit(1.0).cast("float")), "lexemes": F.array().cast("array<string>")}
    at = store.IndexStore(spark, folder(spark, "pages"), buckets=4)
    at.replace(rows.select(*[own.get(c, F.lit("")).alias(c) for c in store.COLUMNS]))
    return retrieval.stored_pages(at.chunks(), 1500).select("url", "text")


@query(
    """SELECT sha256('https://x.org/docs/' || source || '.html#a' || doc_id || '#' || lang || ' > h' || doc_id) AS chunk_key, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN '!' ELSE '' END) AS content_sha256, 'v1' AS index_version FROM documents WHERE doc_id % 11 <> 0"""
)
def r5_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Live pages of which a fifth drifted; sections that only one side has are left alone.  Content, hash, vector
    and lexemes heal; the version tells of the build."""
    at = store.IndexStore(spark, folder(spark, "refresh"), width=2, buckets=4)
    lexemes = lambda c: plain_tokens(c)
    build.build_index(at, _units(spark, sf).where("doc_id % 11 <> 0"), _embed, lexemes, "v1")
    build.refresh(at, _units(spark, sf, F.col("doc_id") % 5 == 0).where("doc_id % 3 <> 0"), _embed, lexemes, "v2")
    return at.chunks().select("chunk_key", F.sha2("content", 256).alias("content_sha256"), "index_version")


@query(
    """SELECT 'k' || doc_id AS chunk_key, CASE WHEN doc_id % 5 = 0 AND (doc_id % 97) IN (SELECT user_id FROM events) THEN 'healed' ELSE 'as it was' END AS state FROM documents"""
)
def t4_stale_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Visits as a stream: pages that are due are compared with the live ones, and their chunks heal."""
    from tessera.streaming import state

    rows = _chunks(spark, sf, F.col("text"))
    at = store.IndexStore(spark, folder(spark, "stale"), width=2, buckets=4)
    at.replace(rows.drop("doc_id"))
    live = rows.where("doc_id % 5 = 0").withColumn("content", F.concat("content", F.lit("!")))
    visits = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    due = state.due(visits.select(_text("=u", "user_id").alias("page"), seconds.alias("t"), F.col("event_id").alias("ord")), "page").where("accepted")

    def heal(batch: DataFrame, number: int) -> None:
        drifted = store.drifted(live.join(batch.select(F.col("key").alias("url")).distinct(), "url", "left_semi"), at.chunks())
        if drifted.head(1):
            at.heal(drifted, ("visits", number))

    run = due.writeStream.foreachBatch(heal).option("checkpointLocation", folder(spark, "stale-log")).trigger(availableNow=True).start()
    run.awaitTermination()
    return at.chunks().join(rows.select("chunk_key", F.col("content").alias("old")), "chunk_key").select("chunk_key", F.when(F.col("content") == F.col("old"), "as it was").otherwise("healed").alias("state"))


@query("SELECT source AS key, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY source")
def u6_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("first"))
    found = manifest.ordered_distinct(rows, "key", "first")
    return found.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "first", "n")


@query("SELECT conv_id AS query_id, role AS url, '' AS anchor, min(turn) AS arrival FROM conversations GROUP BY conv_id, role")
def u7_first_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("url"), F.lit("").alias("anchor"), F.col("turn").alias("arrival"))
    return manifest.first_sections(rows).select("query_id", "url", "anchor", "arrival")


@query("SELECT turn, conv_id FROM (SELECT *, row_number() OVER (ORDER BY turn DESC, conv_id) AS n FROM conversations) WHERE n <= 25")
def o8_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.first_rows(table(spark, sf, "conversations").select("turn", "conv_id"), 25, F.desc("turn"), "conv_id")


@query("SELECT r_name AS name, CASE r_regionkey % 3 WHEN 0 THEN r_regionkey + 0.5 ELSE 7.0 END::DOUBLE AS value, CASE r_regionkey % 3 WHEN 0 THEN 384 ELSE r_regionkey END::INT AS width FROM region")
def x29_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers from the environment, of which a third is given, one malformed and one missing; widths by model or given."""
    import os

    from tessera.config import embed_dims, env_float

    rows = [(r.r_name, r.r_regionkey) for r in table(spark, sf, "region").collect()]  # five rows
    given = {f"TESSERA_SET_{k}": str(k + 0.5) if k % 3 == 0 else "many" for _, k in rows if k % 3 < 2}
    os.environ.update(given)
    try:
        found = [(n, env_float(f"TESSERA_SET_{k}", 7.0), embed_dims("small") if k % 3 == 0 else embed_dims("unknown", k)) for n, k in rows]
    finally:
        for name in given:
            del os.environ[name]
    return spark.createDataFrame(found, "name string, value double, width int")
