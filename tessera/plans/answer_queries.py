"""Queries of retrieval with symbols and filters, of gates, answers, their checks and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import KINDS
from tessera.functions import lexemes as lx
from tessera.functions import text as tx
from tessera.operators import cells, checks, gates, manifest, metrics, render, retrieval
from tessera.plans import evaluation
from tessera.plans.queries import _BASE, _FUSED, ORACLE_SQL
from tessera.plans.registry import chunk_table, folder, query, query_table, table


def _text(*parts) -> F.Column:
    """Columns by name and literals, joined; a leading ``=`` marks a literal."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else (F.col(p).cast("string") if isinstance(p, str) else p) for p in parts])


def _swap(sql: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        assert sql.count(old) == 1, old
        sql = sql.replace(old, new)
    return sql


# retrieval


@query(ORACLE_SQL["o1_dense_pools"])
def v1_cell_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Dense pools from an index of cells, all of which are looked at."""
    chunks = chunk_table(spark, sf)
    index = cells.CellIndex.build(chunks, folder(spark, "cells"))
    found = index.hits(None, query_table(spark, sf), probe=len(index.centres))
    return found.withColumn("dist", F.round("dist", 6))


@query(_swap(ORACLE_SQL["o1_dense_pools"], ("SELECT query_id, kind, chunk_key, round(dist, 6) AS dist, CAST(dense_rank AS INT) AS dense_rank FROM dense", "SELECT count(DISTINCT query_id) AS queries, count(*) AS hits, true AS enough FROM dense")))
def v2_cell_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Queries, exact hits, and that the cell index at its default finds at least nine tenths of them."""
    chunks, asked = chunk_table(spark, sf), query_table(spark, sf)
    index = cells.CellIndex.build(chunks, folder(spark, "cells"))
    some = index.hits(None, asked).select("query_id", "kind", "chunk_key", F.lit(1).alias("found"))
    both = retrieval.dense_hits(chunks, asked).join(some, ["query_id", "kind", "chunk_key"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("hits"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


_ASKED = """CASE WHEN vec_id % 150 = 0 THEN 'src7' END AS library, CASE WHEN vec_id % 100 = 0 THEN 'api' WHEN vec_id % 100 = 50 AND vec_id % 150 = 50 THEN 'nonsense' END AS kind"""
_FILTER = "(q.library IS NULL OR q.library = c.library) AND (q.kind IS NULL OR q.kind NOT IN ('api', 'tutorial', 'guide') OR q.kind = c.kind)"
_FILTERED = _swap(
    _FUSED,
    ("any_value(embedding) AS vector, list(w ORDER BY n) AS words FROM tokens WHERE n <= 2 GROUP BY vec_id", f"any_value(embedding) AS vector, list(w ORDER BY n) AS words, any_value({_ASKED.split(' AS library, ')[0]}) AS library, any_value({_ASKED.split(' AS library, ')[1].removesuffix(' AS kind')}) AS kind FROM tokens WHERE n <= 2 GROUP BY vec_id"),
    ("SELECT query_id, kind, chunk_key, CAST(list_cosine_distance(embedding::DOUBLE[], vector::DOUBLE[]) AS DOUBLE) AS dist FROM queries, chunks\n", f"SELECT query_id, c.kind, chunk_key, CAST(list_cosine_distance(embedding::DOUBLE[], vector::DOUBLE[]) AS DOUBLE) AS dist FROM queries q, chunks c WHERE {_FILTER}\n"),
    ("FROM (SELECT query_id, kind, chunk_key, len(list_filter(lexemes, lambda x: list_contains(words, x))) AS score FROM queries, chunks WHERE list_has_all(lexemes, words))", f"FROM (SELECT query_id, c.kind, chunk_key, len(list_filter(lexemes, lambda x: list_contains(words, x))) AS score FROM queries q, chunks c WHERE list_has_all(lexemes, words) AND {_FILTER})"),
)


def _restricted(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("query_id").cast("long")
    kind = F.when(n % 100 == 0, "api").when((n % 100 == 50) & (n % 150 == 50), "nonsense")
    return query_table(spark, sf).withColumns({"library": F.when(n % 150 == 0, "src7"), "kind": kind})


@query(f"WITH {_FILTERED} SELECT query_id, CAST(rank AS INT) AS rank, url, heading_path AS title, sha256(text) AS content_sha256, round(dist, 6) AS dist FROM final JOIN chunks USING (chunk_key) WHERE rank <= 8 AND coalesce(text, '') <> ''")
def r3_search_tool(spark: SparkSession, sf: str) -> DataFrame:
    """Searches restricted to a library, a kind, both or neither; an unknown kind means every kind."""
    found = retrieval.search(chunk_table(spark, sf), _restricted(spark, sf))
    return found.select("query_id", "rank", "url", "title", F.sha2("content", 256).alias("content_sha256"), F.round("dist", 6).alias("dist"))


@query(f"WITH {_FILTERED} SELECT 'dense' AS pool, query_id, kind, chunk_key, CAST(dense_rank AS INT) AS rank FROM dense UNION ALL SELECT 'keyword', query_id, kind, chunk_key, CAST(keyword_rank AS INT) FROM keyword")
def f2_filtered_pools(spark: SparkSession, sf: str) -> DataFrame:
    chunks, asked = chunk_table(spark, sf), _restricted(spark, sf).withColumn("kind", tx.known_kind(F.col("kind")))
    dense = retrieval.dense_hits(chunks, asked).select(F.lit("dense").alias("pool"), "query_id", "kind", "chunk_key", F.col("dense_rank").alias("rank"))
    return dense.union(retrieval.keyword_hits(retrieval.postings(chunks, queries=asked), asked).select(F.lit("keyword"), "query_id", "kind", "chunk_key", "keyword_rank"))


_NAMES = ("https://example.org/docs/generated/torch.nn.item_", "https://example.org/tutorials/item_", "https://example.org/guide/topic")


def _named_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table with identifiers in urls and titles: forty API names, tutorials about them, other guides."""
    n = F.col("chunk_key").cast("long")
    url = F.when(F.col("kind") == "api", F.concat(F.lit(_NAMES[0]), n % 40, F.lit(".html"))).when(F.col("kind") == "tutorial", F.concat(F.lit(_NAMES[1]), n % 40, F.lit("_use.html"))).otherwise(F.concat(F.lit(_NAMES[2]), n, F.lit(".html")))
    title = F.when(n % 3 == 0, F.concat(F.lit("About Item_"), n % 11)).otherwise("Page")
    return chunk_table(spark, sf).withColumns({"url": url, "page_title": title})


def _symbol_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three queries name an item, in words that no chunk has."""
    n = F.col("query_id").cast("long")
    named = F.concat(F.lit("0 item_"), (n / 50).cast("long") % 12, F.lit(" 0"))
    return query_table(spark, sf).withColumn("query", F.when(n % 150 != 0, named).otherwise(F.col("query")))


_SYMBOLS = (
    _swap(
        _FUSED,
        ("'https://example.org/' || source || '/' || doc_id || '.html' AS url", f"CASE label % 3 WHEN 0 THEN '{_NAMES[0]}' || (doc_id % 40) || '.html' WHEN 1 THEN '{_NAMES[1]}' || (doc_id % 40) || '_use.html' ELSE '{_NAMES[2]}' || doc_id || '.html' END AS url"),
        ("'Page ' || doc_id AS page_title", "CASE WHEN doc_id % 3 = 0 THEN 'About Item_' || (doc_id % 11) ELSE 'Page' END AS page_title"),
    )
    + """, asked AS (SELECT query_id, 'item_' || (CAST(query_id AS BIGINT) // 50 % 12) AS symbol FROM queries WHERE CAST(query_id AS BIGINT) % 150 <> 0),
symbols AS (
  SELECT * FROM (SELECT query_id, chunk_key, kind, kind = 'api' AND (regexp_replace(string_split(url, '/')[-1], '\\.html$', '') = symbol OR ends_with(regexp_replace(string_split(url, '/')[-1], '\\.html$', ''), '.' || symbol)) AS exact,
    row_number() OVER (PARTITION BY query_id ORDER BY (kind = 'api') DESC, length(url), chunk_key) AS symbol_rank
  FROM asked, chunks WHERE contains(lower(url || chr(10) || page_title || chr(10) || heading_path), lower(symbol))) WHERE symbol_rank <= 20
)"""
)


@query(f"WITH {_SYMBOLS} SELECT query_id, chunk_key, kind, exact, CAST(symbol_rank AS INT) AS symbol_rank FROM symbols")
def f4_symbol_pools(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.symbol_hits(_named_chunks(spark, sf), _symbol_queries(spark, sf))


@query(
    f"""WITH RECURSIVE {_SYMBOLS}, known AS (SELECT query_id, chunk_key, min(dist) AS dist FROM fused GROUP BY ALL),
pooled AS (
  SELECT query_id, 'symbol' AS pool, 0 AS later, chunk_key, symbol_rank AS n, exact FROM symbols
  UNION ALL SELECT f.query_id, f.kind, 1, f.chunk_key, pool_rank, coalesce(s.exact, false) FROM fused f LEFT JOIN symbols s USING (query_id, chunk_key)
), near AS (
  SELECT p.*, k.dist, min(k.dist) OVER (PARTITION BY p.query_id, pool) AS strength FROM pooled p LEFT JOIN known k USING (query_id, chunk_key)
), lists AS (
  SELECT query_id, pool, any_value(later) AS later, any_value(strength) AS strength, coalesce(list(chunk_key ORDER BY n) FILTER (WHERE dist IS NULL OR strength IS NULL OR dist <= strength + 0.15), []) AS items FROM near GROUP BY ALL
), turns AS (
  SELECT query_id, list(items ORDER BY later, strength NULLS LAST, CASE pool WHEN 'api' THEN 0 WHEN 'tutorial' THEN 1 ELSE 2 END) AS pools FROM lists GROUP BY query_id
), taken AS (
  SELECT query_id, pools, 0 AS step, [] :: VARCHAR[] AS got FROM turns
  UNION ALL
  SELECT query_id, pools, step + 1, CASE WHEN len(got) < 8 AND len(list_filter(pools[step % len(pools) + 1], lambda x: NOT list_contains(got, x))) > 0
    THEN list_append(got, list_filter(pools[step % len(pools) + 1], lambda x: NOT list_contains(got, x))[1]) ELSE got END FROM taken WHERE step < 8 * len(pools)
), last AS (SELECT query_id, got FROM taken WHERE step = 8 * len(pools)),
pins AS (SELECT query_id, min_by(chunk_key, CASE pool WHEN 'symbol' THEN 0 WHEN 'api' THEN 1 WHEN 'tutorial' THEN 2 ELSE 3 END * 1000 + n) AS pin FROM pooled WHERE exact GROUP BY query_id),
named AS (SELECT l.query_id, CASE WHEN pin IS NULL THEN got ELSE list_prepend(pin, list_filter(got, lambda x: x <> pin)) END AS keys FROM last l LEFT JOIN pins p USING (query_id))
SELECT n.query_id, CAST(i AS INT) AS rank, keys[i] AS chunk_key, round(dist, 6) AS dist FROM (SELECT query_id, keys, unnest(range(1, least(8, len(keys)) + 1)) AS i FROM named) n LEFT JOIN known k ON k.query_id = n.query_id AND k.chunk_key = keys[i]"""
)
def r1_symbols_and_pin(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval where the symbol pool overlaps the others and exact API pages are pinned."""
    found = retrieval.retrieve(_named_chunks(spark, sf), _symbol_queries(spark, sf))
    return found.select("query_id", "rank", "chunk_key", F.round("dist", 6).alias("dist"))


@query(
    f"""WITH {_BASE}, near AS (SELECT query_id, min(CASE WHEN flipped THEN 2 - dist ELSE dist END) AS dist FROM (SELECT *, CAST(query_id AS BIGINT) % 100 = 50 AS flipped FROM dense_all) GROUP BY query_id),
q AS (SELECT query_id, CASE CAST(query_id AS BIGINT) // 50 % 5 WHEN 0 THEN repeat('a', 2001) WHEN 1 THEN 'ééé question' ELSE 'question' END AS text, dist FROM near)
SELECT query_id, CASE WHEN length(text) > 2000 THEN 'too_long' WHEN len(regexp_extract_all(text, '[^\\x00-\\x7f]')) > greatest(2, length(text) * 0.1) THEN 'non_english' WHEN dist > 0.35 THEN 'off_topic' ELSE '' END AS reason,
CASE WHEN length(text) <= 2000 AND NOT len(regexp_extract_all(text, '[^\\x00-\\x7f]')) > greatest(2, length(text) * 0.1) THEN round(dist, 6) END AS dist FROM q"""
)
def f11_guard_distances(spark: SparkSession, sf: str) -> DataFrame:
    """All three gates; half of the vectors point away from the chunks, and dear distances are only for cheap passes."""
    n = F.col("query_id").cast("long")
    question = F.when((n / 50).cast("long") % 5 == 0, F.repeat(F.lit("a"), F.lit(2001))).when((n / 50).cast("long") % 5 == 1, "ééé question").otherwise("question")
    flipped = F.when(n % 100 == 50, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    asked = query_table(spark, sf).withColumns({"query": question, "vector": flipped})
    # distances to a vector that points away are 2 minus the ones to the vector itself, so the least is 2 minus the largest
    found = gates.guarded(asked, chunk_table(spark, sf))
    return found.select("query_id", F.col("verdict.reason").alias("reason"), F.round("dist", 6).alias("dist"))


@query("SELECT event_type AS chain, user_id AS name FROM (SELECT event_type, user_id, max(value) AS until FROM events GROUP BY ALL) x JOIN (SELECT event_type, min(value) AS least FROM (SELECT event_type, user_id, max(value) AS value FROM events GROUP BY ALL) GROUP BY event_type) y USING (event_type) WHERE NOT coalesce(until > 30, false) OR least > 30")
def t3_available(spark: SparkSession, sf: str) -> DataFrame:
    """Providers whose deadline has passed, or all of a chain where none has."""
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("chain"), F.col("user_id").alias("name")).agg(F.max("value").alias("until"))
    return gates.available(rows, F.lit(30.0)).select("chain", "name")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, CASE WHEN event_type = 'error' THEN value * 1000 END AS cooldown, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, true AS usable, CASE WHEN cooldown IS NOT NULL THEN t + least(900, cooldown) END AS until FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, r.until IS NULL OR e.t >= r.until, CASE WHEN e.cooldown IS NOT NULL THEN e.t + least(900, e.cooldown) ELSE r.until END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(usable::INT) AS BIGINT) AS usable FROM r GROUP BY user_id"""
)
def t3_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """Failures as a stream: each sets a deadline of at most 900 seconds; calls before it are skipped."""
    from tessera.streaming import state

    rows = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    timed = rows.select("user_id", seconds.alias("t"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", F.col("value") * 1000).alias("cooldown"))
    where = folder(spark, "cooled")
    run = state.cooled(timed, "user_id").writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema("key string, t double, usable boolean").parquet(f"{where}/out")
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, t AS last, true AS accepted FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t - r.last >= 3600 THEN e.t ELSE r.last END, e.t - r.last >= 3600 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(accepted::INT) AS BIGINT) AS accepted, max(last) + 3600 <= (SELECT max(t) - 3600 FROM e) AS idle FROM r GROUP BY user_id"""
)
def t1_idle_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows of each key, and whether its state has left by the end of the stream."""
    from tessera.streaming import idle

    rows = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    found = _ended(spark, idle.due(rows.select("user_id", seconds.alias("t"), F.col("event_id").alias("ord")), "user_id", 3600.0, "1 hour", tell_idle=True), "idle-due")
    return found.groupBy("key").agg(F.count("accepted").alias("n"), F.count_if("accepted").alias("accepted"), F.max_by(F.col("accepted").isNull(), F.struct("t", F.col("accepted").isNull())).alias("idle"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, CASE WHEN event_type = 'error' THEN value * 1000 END AS cooldown, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, true AS usable, CASE WHEN cooldown IS NOT NULL THEN t + least(900, cooldown) END AS until FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, r.until IS NULL OR e.t >= r.until, CASE WHEN e.cooldown IS NOT NULL THEN e.t + least(900, e.cooldown) ELSE r.until END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(usable::INT) AS BIGINT) AS usable FROM r GROUP BY user_id"""
)
def t3_idle_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """Deadlines as a stream whose state leaves once they have passed."""
    from tessera.streaming import idle

    rows = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    timed = rows.select("user_id", seconds.alias("t"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", F.col("value") * 1000).alias("cooldown"))
    found = _ended(spark, idle.cooled(timed, "user_id"), "idle-cooled")
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable"))


def _ended(spark: SparkSession, out: DataFrame, label: str) -> DataFrame:
    """Rows of a keyed stream that ends, written in the shared folder."""
    from tessera.streaming.idle import keyed_state

    where = folder(spark, label)
    with keyed_state(spark):
        out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")


# sections and context


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stored' ELSE 'live ' || lang END AS content FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0"""
)
def p21_hydrated(spark: SparkSession, sf: str) -> DataFrame:
    """Pointers with stored content keep it; others take that of the live unit with equal headings and part, or drop out."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", _text("=u", "doc_id").alias("url"))
    pointers = docs.select("doc_id", "url", _text("=A > ", "lang").alias("heading_path"), (F.col("doc_id") % 2).cast("int").alias("part"), F.when(F.col("doc_id") % 3 == 0, "stored").otherwise("").alias("content"))
    fitting = docs.select("url", F.array(F.lit("A"), "lang").alias("heading_path"), (F.when(F.col("doc_id") % 5 == 0, 7).otherwise(F.col("doc_id") % 2)).cast("int").alias("part"), _text("=live ", "lang").alias("content"))
    return retrieval.hydrated(pointers, fitting).select("doc_id", "content")


@query(
    """SELECT 'u' || doc_id AS url, CASE WHEN length(coalesce(text, '')) > 3000 THEN 'A > ' || lang || chr(10) || 'B' ELSE coalesce(text, '') END AS text FROM documents"""
)
def p23_whole_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page, or the outline of its headings in their order where it is over the limit."""
    docs = table(spark, sf, "documents").select(_text("=u", "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("body"), "lang")
    units = docs.select("url", F.explode(F.array(F.struct(F.lit(2).alias("ordinal"), F.array(F.lit("B")).alias("heading_path")), F.struct(F.lit(0).alias("ordinal"), F.array(F.lit("A"), "lang").alias("heading_path")), F.struct(F.lit(1).alias("ordinal"), F.array(F.lit("A"), "lang").alias("heading_path")))).alias("u")).select("url", "u.*")
    return retrieval.whole_page(docs.select("url", "body"), units, 3000)


_BLOCKS = """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, role, text FROM conversations"""


@query(
    f"""WITH s AS ({_BLOCKS}) SELECT conv_id AS query_id, sha256(string_agg('[' || rank || '] H > ' || role || ' (u' || turn || '#a)' || chr(10) || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '[... truncated]' ELSE text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_sha256,
string_agg(role, ' · ' ORDER BY rank) FILTER (WHERE rank <= 4 AND role <> '') AS titles FROM s GROUP BY conv_id"""
)
def p18_context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered sections of each conversation, each cut with a marker, and the preview of their titles."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    sections = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), rank.alias("rank"), _text("=H > ", "role").alias("heading_path"), _text("=u", "turn").alias("url"), F.lit("a").alias("anchor"), F.col("text").alias("content"))
    context = retrieval.context_blocks(sections, 200)
    return context.join(retrieval.title_previews(sections), "query_id").select("query_id", F.sha2("context", 256).alias("context_sha256"), "titles")


# answers


def _cited() -> tuple[F.Column, F.Column]:
    """Citations and referrals of a document's answer: none, one or two."""
    one = lambda k: F.struct(_text(f"=https://x.org/p{k}-", "doc_id").alias("url"), F.when(F.col("doc_id") % 2 == 0, f"a{k}").otherwise("").alias("anchor"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(_text(f"=Title {k} ", "lang")).alias("title"))
    many = F.slice(F.array(one(1), one(2)), 1, (F.col("doc_id") % 3).cast("int"))
    links = F.slice(F.array(F.struct(F.lit("https://s.org").alias("url"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("source").alias("reason"))), 1, (F.col("doc_id") % 2).cast("int"))
    return many, links


_CITED = """c AS (SELECT doc_id, lang, list_transform(range(1, CAST(doc_id % 3 + 1 AS BIGINT)), lambda k: {'url': 'https://x.org/p' || k || '-' || doc_id, 'anchor': CASE WHEN doc_id % 2 = 0 THEN 'a' || k ELSE '' END, 'title': CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Title ' || k || ' ' || lang END}) AS cites FROM documents)"""


@query(
    f"""WITH {_CITED} SELECT doc_id, 'Answer ' || doc_id
|| CASE WHEN len(cites) > 0 THEN chr(10) || chr(10) || '---' || chr(10) || '**Sources**' || chr(10) || array_to_string(list_transform(cites, lambda c: '- [' || CASE WHEN c.title = '' THEN c.url ELSE c.title END || '](' || c.url || CASE WHEN c.anchor = '' THEN '' ELSE '#' || c.anchor END || ')'), chr(10)) ELSE '' END
|| CASE WHEN doc_id % 2 = 1 THEN chr(10) || chr(10) || '**Beyond these docs**' || chr(10) || '- [' || CASE WHEN doc_id % 4 = 0 THEN 'https://s.org' ELSE 'source' END || '](https://s.org)' ELSE '' END
|| CASE WHEN doc_id % 3 = 1 THEN chr(10) || chr(10) || '<sub>for version 2.4</sub>' ELSE '' END
|| CASE WHEN len(cites) > 0 THEN chr(10) || chr(10) || '{render.LICENCE}' ELSE '' END AS md FROM c"""
)
def p29_answers(spark: SparkSession, sf: str) -> DataFrame:
    many, links = _cited()
    version = F.element_at(F.array(F.lit("unknown"), F.lit("2.4"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", render.answer_markdown(_text("=Answer ", "doc_id"), many, links, version).alias("md"))


@query(
    f"""WITH {_CITED} SELECT doc_id, 'QUESTION:' || chr(10) || 'why ' || lang || chr(10) || chr(10) || 'CONTEXT SECTIONS:' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '(none retrieved)' ELSE 'ctx' END || chr(10) || chr(10) || 'ANSWER:' || chr(10) || 'A' || doc_id || chr(10) || chr(10) || 'ANSWER CITATIONS:' || chr(10)
|| CASE WHEN len(cites) = 0 THEN '  (none)' ELSE array_to_string(list_transform(cites, lambda c: '  - ' || c.url || '#' || c.anchor || ' (' || c.title || ')'), chr(10)) END AS prompt,
array_to_string(list_transform(cites, lambda c: lower(c.url || ' ' || c.anchor || ' ' || c.title)), '|') AS hays,
array_to_string(list_transform(list_filter(cites, lambda c: c.url = 'https://x.org/p2-' || doc_id), lambda c: c.url), '|') AS known FROM c"""
)
def p33_judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The judge's prompt, what is searched of citations, and the citations of pages that were shown."""
    many, _ = _cited()
    prompt = metrics.judge_prompt(_text("=why ", "lang"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("ctx"), _text("=A", "doc_id"), many)
    known = F.transform(checks.known_citations(many, F.array(_text("=https://x.org/p2-", "doc_id"), F.lit("https://x.org/none"))), lambda c: c["url"])
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"), F.array_join(metrics.citation_hays(many), "|").alias("hays"), F.array_join(known, "|").alias("known"))


@query("SELECT doc_id AS id, 'u' || k AS url FROM documents, (SELECT unnest([1, 2, 3]) AS k) WHERE k <> 3 AND (k <> 2 OR doc_id % 2 = 0)")
def j17_cited_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Citations in rows against the sections that were shown, some of them twice."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    cited = docs.select("id", F.explode(F.array(*[F.lit(f"u{k}") for k in (1, 2, 3)])).alias("url"))
    shown = docs.select("id", F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("u1"), F.lit("u2"), F.lit("u2"))).otherwise(F.array(F.lit("u1"), F.lit("u1")))).alias("url"))
    return checks.cited_sections(cited, shown)


_KINDS_OF_CODE = (
    "Use `Linear`.\n```python\nimport torch\nimport os.path\nx = 1\n```",
    "```py\nx = (\n```",
    "```Python\nfrom numpy import array\n```",
    "```python\n  from . import x\n  y = 2\n```",
    "no code, but relu and nn.Linear; prelu2",
    "```text\nimport numpy\n```\n```python\nfrom torch.nn import Linear\n```",
)


@query(
    """SELECT doc_id, doc_id % 6 <> 1 AS parses, doc_id % 6 NOT IN (2, 3) AS imports, doc_id % 6 IN (0, 4, 5) AS symbols,
CASE WHEN doc_id % 6 = 1 THEN '' WHEN doc_id % 6 = 2 THEN 'numpy' WHEN doc_id % 6 = 3 THEN '.' ELSE '' END AS foreign_name FROM documents"""
)
def f14_static_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of six kinds: whole, broken, foreign and relative imports, without code, another language."""
    answer = F.element_at(F.array(*map(F.lit, _KINDS_OF_CODE)), (F.col("doc_id") % 6 + 1).cast("int"))
    found = table(spark, sf, "documents").select("doc_id", checks.run_checks(answer, F.array(F.lit("torch.nn.Linear"))).alias("c"))
    foreign = F.regexp_extract(F.coalesce("c.imports", F.lit("")), r"imports (\S*)$", 1)
    return found.select("doc_id", F.col("c.parses").isNull().alias("parses"), F.col("c.imports").isNull().alias("imports"), F.col("c.symbols").isNull().alias("symbols"), foreign.alias("foreign_name"))


@query(
    """SELECT doc_id AS id, rpad(CAST(doc_id AS VARCHAR), 8, ' ') || CASE WHEN doc_id % 3 = 1 THEN 'FAIL      ' ELSE 'ok        ' END || 'ok        ' || CASE WHEN doc_id % 3 = 2 THEN 'FAIL      ' ELSE 'ok        ' END
|| CASE WHEN doc_id % 3 = 1 THEN chr(10) || '         parses: broken' WHEN doc_id % 3 = 2 THEN chr(10) || '         symbols: gone' ELSE '' END AS line FROM documents"""
)
def p32_check_table(spark: SparkSession, sf: str) -> DataFrame:
    found = F.struct(F.when(F.col("doc_id") % 3 == 1, "broken").alias("parses"), F.lit(None).cast("string").alias("imports"), F.when(F.col("doc_id") % 3 == 2, "gone").alias("symbols"))
    return checks.check_table(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), found.alias("checks")))


@query(
    """WITH a AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT doc_id AS id, CASE k WHEN 0 THEN NULL WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END :: DOUBLE AS rate, CAST(doc_id % 3 AS INT) AS n_citations, k IN (0, 1) AS passed FROM a"""
)
def r9_static_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The static benchmark's rows: share of symbols that the index has, citations, whether all checks pass."""
    rows, _ = _static(spark, sf)
    return rows.select("id", "rate", "n_citations", "passed")


@query(
    """SELECT avg(CASE doc_id % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.0 END) :: DOUBLE AS rate, avg(doc_id % 3) AS citations, count(*) FILTER (WHERE doc_id % 4 IN (0, 1)) AS passed FROM documents"""
)
def a17_static_means(spark: SparkSession, sf: str) -> DataFrame:
    return _static(spark, sf)[1]


def _static(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("doc_id") % 4
    symbols = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("torch.nn.Linear"), F.lit("torch.relu"))).when(k == 2, F.array(F.lit("torch.relu"), F.lit("torch.made_up"))).otherwise(F.array(F.lit("torch.none")))
    cites = F.array_repeat(F.struct(F.lit("u").alias("url")), (F.col("doc_id") % 3).cast("int"))
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("Use Linear and relu.\n```python\nimport torch\n```").alias("answer_md"), symbols.alias("symbols_used"), cites.alias("citations"))
    index = table(spark, sf, "documents").select(F.explode(F.array(F.lit("torch.nn.linear"), F.lit("torch.relu"), "lang")).alias("lexeme"))
    return evaluation.static_benchmark(answers, index)


@query(
    """WITH g AS (SELECT item_id, unnest([0, 1, 2]) AS k, text FROM benchmark)
SELECT item_id AS id, k AS "group" FROM g WHERE k = 0 OR (k = 1 AND item_id % 2 = 0)"""
)
def j16_grounded_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Expected groups with a pattern in an inventory name: part of one, in another case, and none."""
    items = table(spark, sf, "benchmark").select("item_id")
    name = F.when(F.col("item_id") % 2 == 0, _text("=api.Item", "item_id", "=.run")).otherwise("api.other")
    groups = F.array(F.array(F.lit("nowhere"), F.lit("API.")), F.array(_text("=iTEM", "item_id", "=.")), F.array(F.lit("missing"), F.lit("")))
    found = manifest.grounded_groups(items.select(F.col("item_id").alias("id"), groups.alias("expected")), items.select(name.alias("name")))
    return found.select("id", F.col("group").cast("int").alias("group"))


@query("SELECT DISTINCT doc_id AS id, s AS symbol FROM documents, (SELECT unnest(['en', 'fr', 'xx']) AS s) WHERE s IN (SELECT lang FROM documents)")
def j14_known_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that some chunk has as a lexeme, by a semi-join with the postings."""
    docs = table(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_key"), F.lit("api").alias("kind"), F.lit("x").alias("library"), F.array("lang").alias("lexemes"))
    names = docs.select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("en"), F.lit("fr"), F.lit("xx"))).alias("symbol"))
    return names.join(retrieval.postings(chunks).select(F.col("lexeme").alias("symbol")), "symbol", "left_semi").select("id", "symbol")


# evaluation


@query(ORACLE_SQL["r6_retrieval_metrics"].replace("lower(text) AS hay", "lower(url || ' ' || page_title || ' ' || heading_path || ' ' || kind || ' ' || text) AS hay").replace("round(avg((first IS NOT NULL)::INT), 6) AS recall", "avg((first IS NOT NULL)::INT) AS recall").replace("round(coalesce(1.0 / min(first), 0), 6) AS mrr FROM hits GROUP BY query_id", "coalesce(1.0 / min(first), 0) AS mrr FROM hits GROUP BY query_id").replace("SELECT query_id AS id, avg(", "SELECT count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) FILTER (WHERE recall = 0) AS zero_recall FROM (SELECT query_id AS id, avg(") + ")")
def r6_benchmark_means(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieval benchmark's means; what is searched has the kind and text in its title so that groups are met."""
    chunks = chunk_table(spark, sf)
    chunks = chunks.withColumn("heading_path", F.concat_ws(" ", "heading_path", "kind", "content"))
    asked = query_table(spark, sf)
    asked = asked.withColumn("expected", F.transform("query_lexemes", lambda w: F.array(w)))
    empty = asked.limit(1).withColumns({"query_id": F.lit("none"), "expected": F.array().cast("array<array<string>>")})
    _, means = evaluation.retrieval_benchmark(chunks, asked.unionByName(empty))
    return means.select("questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "zero_recall")


_COVER = """x AS (SELECT doc_id, doc_id % 3 AS n, (doc_id % 2 = 0)::INT + (doc_id % 4 = 1)::INT AS unused FROM documents),
y AS (SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE (1.0 + CASE WHEN n = 2 AND doc_id % 2 = 0 THEN 1 ELSE 0 END) / n END AS agentic, CASE WHEN n = 0 THEN 0.0 WHEN doc_id % 5 = 0 THEN 1.0 / n ELSE 0.0 END AS single FROM x)"""


@query(f"WITH {_COVER} SELECT doc_id AS id, agentic :: DOUBLE AS agentic, single :: DOUBLE AS single FROM y")
def a12_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of expected groups that an answer's citations meet, for two ways of answering."""
    return _coverage(spark, sf)[0]


@query(f"WITH {_COVER} SELECT round(avg(agentic), 9) AS agentic, round(avg(single), 9) AS single, round(avg(agentic - single), 9) AS delta FROM y")
def a13_coverage_means(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf)[1].select(*[F.round(c, 9).alias(c) for c in ("agentic", "single", "delta")])


def _coverage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("doc_id") % 3
    groups = F.slice(F.array(F.array(F.lit("nope"), F.lit("FIRST")), F.array(F.lit("second"))), 1, n.cast("int"))
    agentic = F.array(F.lit("the first page"), F.when(F.col("doc_id") % 2 == 0, "second").otherwise("third"))
    single = F.array(F.when(F.col("doc_id") % 5 == 0, "first").otherwise("none"))
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), groups.alias("expected"), agentic.alias("agentic"), single.alias("single"))
    return evaluation.coverage_benchmark(answers)


_SCORES = """s AS (SELECT event_id, event_id % 5 + 1 AS a, event_id % 3 + 2 AS b, CASE WHEN event_id % 7 = 0 THEN 9 ELSE 5 END AS c, value FROM events),
j AS (SELECT *, c <= 5 AS good FROM s)"""


@query(f"WITH {_SCORES} SELECT count(*) FILTER (WHERE good) AS scored, round(avg((a - 1) / 4.0) FILTER (WHERE good), 9) AS faithfulness, round(avg((b - 1) / 4.0) FILTER (WHERE good), 9) AS relevance, round(avg((c - 1) / 4.0) FILTER (WHERE good), 9) AS citation, round(avg(((a - 1) / 4.0 + (b - 1) / 4.0 + (c - 1) / 4.0) / 3) FILTER (WHERE good), 9) AS overall FROM j")
def r8_judge_means(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with fences and prose around the scores; scores beyond 5 do not count."""
    _, means, _ = _judged(spark, sf)
    return means.select("scored", *[F.round(c, 9).alias(c) for c in ("faithfulness", "relevance", "citation", "overall")])


@query("WITH v AS (SELECT round_even(value, 2) AS v FROM (SELECT value FROM events)), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v WHERE v IS NOT NULL) SELECT max(n) AS n, min(v) FILTER (WHERE i = least(n - 1, floor(n * 0.5))) AS p50, min(v) FILTER (WHERE i = least(n - 1, floor(n * 0.95))) AS p95, max(v) AS max, round(avg(v), 6) AS mean FROM o")
def r8_judge_latencies(spark: SparkSession, sf: str) -> DataFrame:
    _, _, latencies = _judged(spark, sf)
    return latencies.withColumn("mean", F.round("mean", 6))


def _judged(spark: SparkSession, sf: str):
    i = F.col("event_id")
    score = lambda c: F.struct(c.cast("int").alias("score"), F.lit("w").alias("why"))
    body = F.to_json(F.struct(score(i % 5 + 1).alias("faithfulness"), score(i % 3 + 2).alias("relevance"), score(F.when(i % 7 == 0, 9).otherwise(5)).alias("citation")))
    reply = F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))
    return evaluation.judge_benchmark(table(spark, sf, "events").where("value is not null").select(i.alias("id"), reply.alias("reply"), F.col("value").alias("latency_s")))


@query("SELECT conv_id AS id, 'repeated' AS fault FROM conversations GROUP BY conv_id HAVING count(*) > 1 UNION ALL SELECT conv_id, 'no groups' FROM conversations WHERE turn % 3 = 0")
def f24_faulty_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that come twice, and questions whose expected groups are empty or missing."""
    groups = F.when(F.col("turn") % 3 != 0, F.array(F.array("role"))).when(F.col("turn") % 2 == 0, F.array().cast("array<array<string>>"))
    return metrics.repeated_ids(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), groups.alias("expected")))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'on' ELSE 'off' END AS \"group\", event_id AS question, CASE WHEN event_id % 7 <> 0 THEN value END AS dist FROM events")
def o10_distance_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, "on").otherwise("off").alias("group"), F.col("event_id").alias("question"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("dist"))
    return metrics.distance_listing(rows)


@query(
    """WITH a AS (SELECT conv_id, turn, CASE (conv_id * 3 + turn * 5) % 7 WHEN 0 THEN 'read_page' WHEN 1 THEN 'ask_source' WHEN 2 THEN 'read_page' WHEN 6 THEN CASE WHEN turn % 2 = 0 THEN 'answer' ELSE 'search_docs' END ELSE 'search_docs' END AS action FROM conversations),
n AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (WHERE action = 'search_docs') OVER p + 1 AS s, count(*) FILTER (WHERE action = 'read_page') OVER p AS r, count(*) FILTER (WHERE action = 'ask_source') OVER p AS k
  FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn), p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE WHEN action = 'answer' OR (s >= 6 AND r >= 2 AND k >= 1) OR n > 11 THEN 'answer' WHEN (action = 'search_docs' AND s < 6) OR (action = 'read_page' AND r < 2) OR (action = 'ask_source' AND k < 1) THEN 'used' ELSE 'refused' END AS outcome FROM n)
SELECT conv_id AS id, turn AS step, action, outcome FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.conv_id = x.conv_id AND y.turn < x.turn AND y.outcome = 'answer')"""
)
def a22_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """What planned steps of each conversation come to under the tools' budgets."""
    code = (F.col("conv_id") * 3 + F.col("turn") * 5) % 7
    action = F.when(code.isin(0, 2), "read_page").when(code == 1, "ask_source").when((code == 6) & (F.col("turn") % 2 == 0), "answer").otherwise("search_docs")
    return render.budgeted(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("step"), action.alias("action")))


# scalars

#: Words and their stems by the published algorithm, and words that are not indexed.
_STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "radically": "radic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "sensibility": "sensibl",
    "triplicate": "triplic", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "controlling": "control", "rolled": "roll", "tensors": "tensor", "x2": "x2",
}
_STOPPED = ("the", "and", "is", "with", "not")
_VALUES = ", ".join(f"('{w}', '{s}')" for w, s in _STEMS.items())


@query(
    f"""WITH v AS (SELECT *, row_number() OVER () - 1 AS n FROM (VALUES {_VALUES}) t(word, stem)), k AS (SELECT count(*) AS n FROM v)
SELECT doc_id, a.stem || ' ' || b.stem || ' ' || a.word || '.' || b.word || ' ' || a.stem || ' ' || b.stem AS stems FROM documents, k, v a, v b WHERE a.n = doc_id % k.n AND b.n = (doc_id * 7 + 3) % k.n"""
)
def x19_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stemmed lexemes of made texts: stop words go, a dotted name counts whole and by its parts."""
    words = list(_STEMS)
    pick = lambda at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    a, b = pick(F.col("doc_id")), pick(F.col("doc_id") * 7 + 3)
    text = F.concat_ws(" ", F.lit("The"), F.upper(a), F.lit("AND"), b, F.lit(", is"), F.concat(a, F.lit("."), b), F.lit("!"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(lx.lexemes(text), " ").alias("stems"))


@query(
    f"""WITH v AS (SELECT *, row_number() OVER () - 1 AS n FROM (VALUES {_VALUES}) t(word, stem)), k AS (SELECT count(*) AS n FROM v),
d AS (SELECT doc_id, a.stem AS s, b.stem AS t FROM documents, k, v a, v b WHERE a.n = doc_id % k.n AND b.n = doc_id // 7 % k.n), q AS (SELECT a.n AS query_id, a.stem AS s, b.stem AS t FROM v a, v b, k WHERE b.n = (a.n * 5 + 1) % k.n)
SELECT CAST(query_id AS VARCHAR) AS query_id, doc_id AS chunk_key FROM q, d WHERE (q.s = d.s OR q.s = d.t) AND (q.t = d.s OR q.t = d.t)"""
)
def f3_stemmed_match(spark: SparkSession, sf: str) -> DataFrame:
    """Queries in other word forms match the chunks that have every stem; stop words of a query ask for nothing."""
    words = list(_STEMS)
    pick = lambda at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws(" the ", pick(F.col("doc_id")), pick(F.floor(F.col("doc_id") / 7))).alias("text"))
    chunks = docs.select(F.col("doc_id").alias("chunk_key"), F.lit("api").alias("kind"), F.lit("x").alias("library"), lx.lexemes("text").alias("lexemes"))
    n = F.col("id")
    asked = spark.range(len(words)).select(n.cast("string").alias("query_id"), F.lit(None).cast("string").alias("library"), F.lit(None).cast("string").alias("kind"), lx.lexemes(F.concat_ws(" ", F.lit("is the"), pick(n), F.lit("with"), pick(n * 5 + 1))).alias("query_lexemes"))
    return retrieval.keyword_hits(retrieval.postings(chunks), asked, pool=1 << 30).select("query_id", "chunk_key")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'torch.nn.L' || doc_id WHEN doc_id % 4 = 1 THEN 'torchvision.x' || doc_id ELSE '' END AS symbol,
doc_id % 4 = 0 AS exact_last, doc_id % 4 < 2 AS exact_whole FROM documents"""
)
def p14_page_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol that a page is about, and whether it is exactly the page of a name."""
    i = F.col("doc_id")
    url = F.when(i % 4 == 0, _text("=https://x.org/generated/torch.nn.L", "doc_id", "=.html")).when(i % 4 == 1, _text("=https://x.org/generated/torchvision.x", "doc_id", "=.html")).when(i % 4 == 2, _text("=https://x.org/generated/numpy.x", "doc_id", "=.html")).otherwise(_text("=https://x.org/torch/index", "doc_id"))
    whole = F.when(i % 4 == 0, _text("=torch.nn.L", "doc_id")).otherwise(_text("=torchvision.x", "doc_id"))
    return table(spark, sf, "documents").select("doc_id", tx.symbol_of_url(url).alias("symbol"), tx.is_exact_api(F.lit("api"), url, _text("=L", "doc_id")).alias("exact_last"), tx.is_exact_api(F.lit(KINDS[0]), url, whole).alias("exact_whole"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://x.org/a/b' || doc_id || '.html' WHEN 1 THEN 'https://x.org/c' || doc_id WHEN 2 THEN 'https://x.org/up' || doc_id WHEN 3 THEN 'https://y.org/z' || doc_id ELSE 'https://x.org/a/page.html#f' || doc_id END AS joined,
replace(url_encode('a b/c&d*~+é' || doc_id), '%2F', '/') AS quoted, doc_id % 5 = 3 AS is_http FROM documents"""
)
def x11_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page made absolute, text quoted for a url, and whether a link is a full one."""
    from tessera.operators.html import url_join

    forms = [_text("=b", "doc_id", "=.html"), _text("=/c", "doc_id"), _text("=../up", "doc_id"), _text("=https://y.org/z", "doc_id"), _text("=#f", "doc_id")]
    link = F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", url_join(F.lit("https://x.org/a/page.html"), link).alias("joined"), tx.url_quoted(_text("=a b/c&d*~+é", "doc_id")).alias("quoted"), tx.is_http_url(link).alias("is_http"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '0:one' || doc_id || ';1:two' WHEN 1 THEN '' WHEN 2 THEN '1:late' WHEN 3 THEN '' WHEN 4 THEN '0:' || repeat('z', 20) ELSE '1:ok' END AS items,
CASE doc_id % 2 WHEN 0 THEN '0:a?|b' || doc_id || '?' ELSE '' END AS lists FROM documents"""
)
def x14_model_items(spark: SparkSession, sf: str) -> DataFrame:
    """Lists in models' replies: prose around them, numbers for text, indexes beyond the batch, blanks, no list."""
    i = F.col("doc_id")
    reply = (
        F.when(i % 6 == 0, _text('=Sure: [{"i": 0, "gloss": " one', "doc_id", '="}, {"i": 1, "gloss": "two"}] done'))
        .when(i % 6 == 1, _text("=no list at all"))
        .when(i % 6 == 2, _text('=[{"i": 1, "gloss": "early"}, {"i": 2, "gloss": "beyond"}, {"i": -1, "gloss": "x"}, {"i": 1, "gloss": "late"}, 7]'))
        .when(i % 6 == 3, _text('=[{"i": 0, "gloss": 5}, {"i": "1", "gloss": "text index"}, {"i": 0, "gloss": "  "}, {"i": 1.5, "gloss": "x"}]'))
        .when(i % 6 == 4, _text('=[{"i": 0, "gloss": "', F.repeat(F.lit("z"), F.lit(90)), '="}]'))
        .otherwise(_text('=[{"i": 0}, {"gloss": "none"}, {"i": 1, "gloss": "ok", "more": [1]}]'))
    )
    lists = F.when(i % 2 == 0, _text('=[{"i": 0, "qs": [" a? ", 3, "", "b', "doc_id", '=?", "c?"]}, {"i": 1, "qs": "no list"}]')).otherwise('[{"i": 0, "qs": []}')
    show = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<i:bigint,values:array<string>>>")), lambda x: F.concat(x["i"].cast("string"), F.lit(":"), F.array_join(x["values"], "|"))), ";")
    return table(spark, sf, "documents").select("doc_id", show(tx.valid_items(reply, F.lit(2), "gloss", 20)).alias("items"), show(tx.valid_items(lists, F.lit(2), "qs", 20, most=2)).alias("lists"))


@query(
    """SELECT conv_id, turn, 'Represent this sentence for searching relevant passages: ' || coalesce(text, '') AS query, replace(replace(replace(replace(replace('<' || role || ' a="' || conv_id || '"> & it''s', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
'Authorization: Bearer [redacted] and [redacted]' AS redacted, CASE WHEN turn % 3 = 0 THEN turn + 0.5 WHEN turn % 3 = 1 THEN NULL ELSE CAST(turn AS DOUBLE) END AS retry, CASE WHEN role = 'user' THEN 'api' END AS kind, 'crawl-20240102-0304' AS stamp FROM conversations"""
)
def x22_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Query prefix, HTML escapes, redaction, retry headers, kinds, version stamps."""
    rows = table(spark, sf, "conversations")
    header = F.when(F.col("turn") % 3 == 0, _text("turn", "=.5")).when(F.col("turn") % 3 == 1, "Wed, 21 Oct 2015 07:28:00 GMT").otherwise(F.col("turn").cast("string"))
    return rows.select(
        "conv_id", "turn", tx.query_text(F.coalesce("text", F.lit(""))).alias("query"), tx.html_escape(_text("=<", "role", '= a="', "conv_id", "=\"> & it's")).alias("escaped"), tx.redacted(_text("=Authorization: Bearer abc", "conv_id", "= and sk-abcdefgh", "turn")).alias("redacted"),
        tx.retry_after(header).alias("retry"), tx.known_kind(F.when(F.col("role") == "user", "api").otherwise(F.col("role"))).alias("kind"), tx.version_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("stamp"),
    )


@query(
    """SELECT conv_id, '<span style="color:var(--body-text-color-subdued)">' || coalesce(string_agg(replace(replace(replace(replace(role || ' <' || turn || '> & "x"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '<br>' ORDER BY turn), '') || CASE WHEN conv_id % 2 = 0 THEN '<br>*' ELSE '' END || '</span>' AS trace FROM conversations GROUP BY conv_id"""
)
def p30_traces(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of each conversation as an escaped trace, half of them still at work."""
    line = _text("role", "= <", "turn", '=> & "x"')
    steps = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))), lambda x: x["s"]).alias("steps"))
    return steps.select("conv_id", render.trace_html(F.col("steps"), F.when(F.col("conv_id") % 2 == 0, "*")).alias("trace"))


@query("SELECT conv_id, turn, json_extract_string(line, '$.role') AS role, CAST(json_extract(line, '$.turn') AS BIGINT) AS value FROM (SELECT conv_id, turn, json_object('role', role, 'turn', turn) AS line FROM conversations)")
def x15_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to JSON and the outermost object of a text back to rows."""
    line = F.concat(F.lit("```json\n"), F.to_json(F.struct("role", "turn")), F.lit("\n``` that was it"))
    read = F.from_json(tx.json_object(line), "role string, turn long")
    return table(spark, sf, "conversations").select("conv_id", "turn", read.alias("r")).select("conv_id", "turn", "r.role", F.col("r.turn").alias("value"))
