"""Hybrid retrieval for many queries in one job: per-kind pools, rank fusion, gate, interleave.

Queries are (query_id, query, vector, library, kind); library and kind may be null (no restriction).
Chunks are (chunk_key, url, page_title, heading_path, library, kind, embedding, lexemes).  A query
costs the same whether it comes alone or among thousands: chunks are read once for all.

Dense distances: chunks are dealt into shards and queries into blocks; a (shard, block) group is
multiplied in slices of at most ``SLICE_CELLS`` distances and keeps ``pool`` rows a query and kind, and shards merge by query.
(``cells`` has the same search over the nearest parts of an index.)
Keyword hits: an equi-join on lexemes, counted by (query, chunk).  Symbols: one automaton of the distinct
ones of all queries, one pass over the chunks.  Gate and interleaving are windows over the pools;
only queries with a symbol, whose pool overlaps the others, take turns in a function.  Content is
joined at the end, for the keys that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import KINDS, Config
from tessera.functions.text import is_exact_api, known_kind, symbol_in_query
from tessera.operators.keyword import KeywordIndex
from tessera.operators.patterns import occurrences
from tessera.streaming.runs import folder
from tessera.workers import lean, lean_cogroup

SHARD_ROWS = 1 << 15
BLOCK_QUERIES = 1 << 10
#: Distances that a task holds at once: those of some queries of a block to all chunks of a shard.
SLICE_CELLS = 1 << 20
UNIT_ROWS = 1 << 12
_ORD = {k: i for i, k in enumerate(KINDS)}


def _deal(chunks: DataFrame, queries: DataFrame):
    """(chunks, queries) by (shard, block), each pair of which meets in one group; chunks without a vector meet none."""
    chunks = chunks.where("embedding is not null")
    shards = max(1, -(-chunks.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chunks.withColumn("shard", F.pmod(F.xxhash64("chunk_key"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    return left.groupBy("shard", "block"), right.groupBy("shard", "block")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; NaN for missing ones and those that are not as wide as the widest."""
    vectors = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    out = np.full((len(sizes), width), np.nan)
    fit = (sizes == width) & (width > 0)
    if len(fit) and fit.all():  # cast in place, without a copy in between
        out[:] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    elif fit.any():
        out[fit] = vectors.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    """``m`` itself with rows of length one, some rows at a time; NaN for those without a direction."""
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in range(0, len(m), UNIT_ROWS):
            m[i : i + UNIT_ROWS] /= np.linalg.norm(m[i : i + UNIT_ROWS], axis=1, keepdims=True)
    return m


def _distances(q: pa.ChunkedArray, c: pa.ChunkedArray, runs: list[tuple[int, int, np.ndarray]] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Cosine distances of the vectors ``q`` to all of ``c``, NaN for zero, missing or unequal ones: some rows of ``q`` at a
    time, with the number of the first, so that at most ``SLICE_CELLS`` distances (or those of one row) are there at once.
    With ``runs`` of (start, end, which rows of ``q``), only those rows meet that run of ``c``; the others get NaN."""
    a, b = _unit(_matrix(q)), _unit(_matrix(c))
    step = max(1, SLICE_CELLS // max(1, len(b)))
    for i in range(0, len(a), step):
        if a.shape[1] != b.shape[1]:
            yield i, np.full((len(a[i : i + step]), len(b)), np.nan)
            continue
        with np.errstate(invalid="ignore"):
            if runs is None:
                found = a[i : i + step] @ b.T
            else:
                found = np.full((len(a[i : i + step]), len(b)), np.nan)
                for start, end, looks in runs:
                    at = np.flatnonzero(looks[i : i + step])
                    found[at, start:end] = a[i + at] @ b[start:end].T
        yield i, np.subtract(1.0, found, out=found)


_HITS = "query_id string, kind string, chunk_key string, dist double"


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[str, int]]:
    """Numbers of the column's values, -1 for null, and the number of each value."""
    coded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), {x: i for i, x in enumerate(coded.dictionary.to_pylist())}


def nearest(pool: int):
    """A function of (chunks, queries) of one group to their ``_HITS``: the pools of the queries' kinds.

    Chunks are taken by kind and key, so a kind is a run of a row of distances, in the order of ties.  Where queries have
    ``cells``, they meet the chunks of these only, taken by kind, cell and key.
    """

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        kinds, named = _coded(c["kind"])
        libraries, shelves = _coded(c["library"])
        keys = np.array(c["chunk_key"].to_pylist(), object).astype(str)
        cells = c["cell"].to_numpy() if "cells" in q.column_names else np.zeros(len(c), int)
        order = np.lexsort((keys, cells, kinds))
        kinds, libraries, cells = kinds[order], libraries[order], cells[order]
        place = np.argsort(np.argsort(keys[order], kind="stable"))
        runs_of_cells = _met(kinds, cells, q["cells"]) if "cells" in q.column_names else None
        runs = {k: tuple(np.searchsorted(kinds, (i, i + 1))) for k, i in named.items()}
        asked = list(zip(q["want_library"].to_pylist(), q["want_kind"].to_pylist(), strict=True))
        queries, chunks, dists, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], []
        for first, found in _distances(q["vector"], c["embedding"].take(pa.array(order)), runs_of_cells):
            for i, row in enumerate(found, first):
                library, kind = asked[i]
                for k in KINDS if kind is None else (kind,):
                    start, end = runs.get(k, (0, 0))
                    here = row[start:end]
                    if library is not None:
                        here = np.where(libraries[start:end] == shelves.get(library, -2), here, np.nan)
                    edge = np.partition(here, pool - 1)[pool - 1] if len(here) > pool else np.nan  # NaN is behind all
                    at = np.flatnonzero(~np.isnan(here) if np.isnan(edge) else here <= edge)
                    at = at[np.lexsort((place[start + at], here[at]))][:pool]
                    queries.append(np.full(len(at), i))
                    chunks.append(order[start + at])
                    dists.append(here[at])
                    of += [k] * len(at)
        take = lambda column, at: column.take(pa.array(np.concatenate(at))).cast(pa.string())
        return pa.table({"query_id": take(q["query_id"], queries), "kind": pa.array(of, pa.string()), "chunk_key": take(c["chunk_key"], chunks), "dist": pa.array(np.concatenate(dists))})

    return run


def _met(kinds: np.ndarray, cells: np.ndarray, looks: pa.ChunkedArray) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, queries) of each run of equal kind and cell: which queries have the cell in their ``looks``."""
    edges = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(cells) != 0)) + 1
    looks = looks.combine_chunks()
    of, at = pc.list_parent_indices(looks).to_numpy(), looks.flatten().to_numpy()
    asked = {cell: np.zeros(len(looks), bool) for cell in np.unique(cells).tolist()}
    for cell, by in asked.items():
        by[of[at == cell]] = True
    return [(start, end, asked[cells[start]]) for start, end in zip([0, *edges], [*edges, len(cells)], strict=True) if end > start]


def wants(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "vector", F.col("library").alias("want_library"), F.col("kind").alias("want_kind"))


def pooled(found: DataFrame, pool: int) -> DataFrame:
    """The nearest ``pool`` of each query and kind, ranked."""
    order = Window.partitionBy("query_id", "kind").orderBy("dist", "chunk_key")
    return found.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= pool)


def dense_hits(chunks: DataFrame, queries: DataFrame, pool: int = Config.pool) -> DataFrame:
    """(query_id, kind, chunk_key, dist, dense_rank): the ``pool`` nearest chunks of each kind a query asks for."""
    left, right = _deal(chunks.select("chunk_key", "kind", "library", "embedding"), wants(queries))
    return pooled(left.cogroup(right).applyInArrow(lean_cogroup(nearest(pool)), _HITS), pool)


def top_distance(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, dist): distance to the nearest chunk of all; NULL where there is none."""
    left, right = _deal(chunks.select("chunk_key", "embedding"), queries.select("query_id", "vector"))

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        best = np.full(len(q), np.inf)
        for first, found in _distances(q["vector"], c["embedding"]):
            best[first : first + len(found)] = np.nan_to_num(found, copy=False, nan=np.inf).min(axis=1, initial=np.inf)
        return pa.table({"query_id": q["query_id"], "dist": pa.array([None if np.isinf(b) else float(b) for b in best], pa.float64())})

    near = left.cogroup(right).applyInArrow(lean_cogroup(run), "query_id string, dist double").groupBy("query_id").agg(F.min("dist").alias("dist"))
    return queries.select("query_id").join(near, "query_id", "left")


def dense_rank_of(chunks: DataFrame, queries: DataFrame, page: str = "url") -> DataFrame:
    """(query_id, best, rank): best distance of pages whose url holds the query's ``page`` text, and the
    exact rank of that distance among all chunks."""
    left, right = _deal(chunks.select("chunk_key", "url", "embedding"), queries.select("query_id", "vector", F.col(page).alias("page")))

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        urls = [u.lower() for u in c["url"].to_pylist()]
        pages, own, last, there = [p.lower() for p in q["page"].to_pylist()], [], None, None
        for first, found in _distances(q["vector"], c["embedding"]):
            for i, row in enumerate(found, first):
                if pages[i] != last:
                    last, there = pages[i], np.array([pages[i] in u for u in urls], bool)
                hit = there & ~np.isnan(row)
                own.append(float(row[hit].min()) if hit.any() else None)
        return pa.table({"query_id": q["query_id"], "best": pa.array(own, pa.float64())})

    best = left.cogroup(right).applyInArrow(lean_cogroup(run), "query_id string, best double").groupBy("query_id").agg(F.min("best").alias("best"))
    left, right = _deal(chunks.select("chunk_key", "embedding"), queries.select("query_id", "vector").join(best, "query_id"))

    def closer(c: pa.Table, q: pa.Table) -> pa.Table:
        edge = np.array([np.nan if b is None else b for b in q["best"].to_pylist()], np.float64)[:, None]
        ahead = np.zeros(len(q), np.int64)
        with np.errstate(invalid="ignore"):
            for first, found in _distances(q["vector"], c["embedding"]):
                ahead[first : first + len(found)] = (found < edge[first : first + len(found)] - 1e-12).sum(axis=1)
        return pa.table({"query_id": q["query_id"], "best": q["best"], "n": pa.array(ahead)})

    ahead = left.cogroup(right).applyInArrow(lean_cogroup(closer), "query_id string, best double, n long").groupBy("query_id").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return ahead.select("query_id", "best", F.when(F.col("best").isNotNull(), F.col("n") + 1).alias("rank"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk_key, kind, library, words) as one row a row and lexeme, with its count."""
    for b in batches:
        words = b.column("words")
        rows = pa.table({"of": pc.list_parent_indices(words), "lexeme": words.flatten()}).group_by(["of", "lexeme"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        if len(rows):
            kept = [b.column(c).take(rows["of"].chunk(0)) for c in ("chunk_key", "kind", "library")]
            yield pa.RecordBatch.from_arrays([rows["lexeme"].chunk(0), *kept, rows["count_all"].chunk(0)], names=["lexeme", "chunk_key", "kind", "library", "tf"])


def postings(chunks: DataFrame, lexemes: str = "lexemes", queries: DataFrame | None = None) -> DataFrame:
    """(lexeme, chunk_key, kind, library, tf): the inverted index; write it bucketed by lexeme to search often.

    Lexemes are counted where the chunk is, so no task aggregates whole texts; with ``queries`` only the postings of their
    ``query_lexemes`` are made.
    """
    rows = chunks.select("chunk_key", "kind", "library", F.col(lexemes).alias("words"))
    of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    words = rows.mapInArrow(lean(_counted), f"lexeme string, chunk_key {of['chunk_key']}, kind {of['kind']}, library {of['library']}, tf long")
    if queries is not None:
        words = words.join(queries.select(F.explode("query_lexemes").alias("lexeme")).distinct(), "lexeme", "left_semi")
    else:
        words = words.repartition("lexeme", "chunk_key")
    return words.groupBy("lexeme", "chunk_key", "kind", "library").agg(F.sum("tf").alias("tf"))


def keyword_hits(index: DataFrame, queries: DataFrame, pool: int = Config.pool) -> DataFrame:
    """(query_id, kind, chunk_key, score, keyword_rank): chunks with every lexeme of the query.

    ``queries`` has ``query_lexemes``; a query without any matches nothing.  The score is the sum of
    the lexemes' counts, ties by key.
    """
    asked = queries.select("query_id", F.col("library").alias("want_library"), F.col("kind").alias("want_kind"), F.array_distinct("query_lexemes").alias("words"))
    asked = asked.select("query_id", "want_library", "want_kind", F.size("words").alias("need"), F.explode("words").alias("lexeme"))
    found = index.join(asked, "lexeme").where(_fits()).groupBy("query_id", "kind", "chunk_key", "need").agg(F.count("*").alias("n"), F.sum("tf").alias("score")).where("n = need")
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "chunk_key")
    return found.withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= pool).select("query_id", "kind", "chunk_key", "score", "keyword_rank")


def bm25(index: DataFrame, queries: DataFrame, lengths: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_key, score): Robertson and Zaragoza's BM25 over ``postings``; ``lengths`` is (chunk_key, n)."""
    corpus = lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    df = index.groupBy("lexeme").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct("query_lexemes")).alias("lexeme"))
    rows = index.join(asked, "lexeme").join(df, "lexeme").join(lengths, "chunk_key").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return rows.groupBy("query_id", "chunk_key").agg(F.sum(idf * gain).alias("score"))


def _fits():
    return (F.col("want_library").isNull() | (F.col("library") == F.col("want_library"))) & (F.col("want_kind").isNull() | (F.col("kind") == F.col("want_kind")))


def symbol_hits(chunks: DataFrame, queries: DataFrame, pool: int = Config.pool) -> DataFrame:
    """(query_id, chunk_key, kind, exact, symbol_rank): chunks whose url, title or headings hold the query's symbol.

    API pages first, then shorter urls.  Chunks are searched once for all distinct symbols and ranked once for all queries
    that ask the same (symbol, library, kind); without a symbol in any query no chunk is read.
    """
    asked = queries.withColumn("symbol", symbol_in_query(F.col("query"))).where("symbol is not null").select("query_id", "symbol", F.lower("symbol").alias("low"), F.col("library").alias("want_library"), F.col("kind").alias("want_kind"))
    if asked.isEmpty():
        return queries.sparkSession.createDataFrame([], "query_id string, chunk_key string, kind string, exact boolean, symbol_rank int")
    hay = F.lower(F.concat_ws("\n", "url", "page_title", "heading_path"))
    fields = chunks.select("chunk_key", "url", "kind", "library", hay.alias("hay"))
    ask = ["symbol", "want_library", "want_kind"]
    both = occurrences(fields, F.col("hay"), asked.select("low"), "low").drop("hay").join(asked.select(*ask, "low").distinct(), "low")
    exact = is_exact_api(F.col("kind"), F.col("url"), F.col("symbol"))
    order = Window.partitionBy(*ask).orderBy((F.col("kind") == "api").desc(), F.char_length("url"), "chunk_key")
    found = both.where(_fits()).withColumn("symbol_rank", F.row_number().over(order)).where(F.col("symbol_rank") <= pool).withColumn("exact", exact)
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ask]
    return asked.alias("a").join(found.alias("f"), same).select("query_id", "chunk_key", "f.kind", "exact", "symbol_rank")


def fused(dense: DataFrame, keyword: DataFrame, constant: int = Config.rrf) -> DataFrame:
    """(query_id, kind, chunk_key, dist, score, pool_rank): reciprocal rank fusion within each pool.

    Ties keep the dense order, then the keyword order.
    """
    rows = dense.select("query_id", "kind", "chunk_key", "dist", "dense_rank", F.lit(None).cast("int").alias("keyword_rank")).unionByName(keyword.select("query_id", "kind", "chunk_key", F.lit(None).cast("double").alias("dist"), F.lit(None).cast("int").alias("dense_rank"), "keyword_rank"))
    one = rows.groupBy("query_id", "kind", "chunk_key").agg(*[F.min(c).alias(c) for c in ("dist", "dense_rank", "keyword_rank")])
    part = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    scored = one.withColumn("score", part("dense_rank") + part("keyword_rank"))
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("keyword_rank"))
    return scored.withColumn("pool_rank", F.row_number().over(order))


def gated(pools: DataFrame, gap: float = Config.relevance_gap) -> DataFrame:
    """Rows of a pool within ``gap`` of its nearest one, or without a distance; ranks anew, and the pool's strength."""
    pool = Window.partitionBy("query_id", "kind")
    kept = pools.withColumn("strength", F.min("dist").over(pool)).where(F.col("dist").isNull() | (F.col("dist") <= F.col("strength") + gap))
    return kept.withColumn("pool_rank", F.row_number().over(pool.orderBy("pool_rank")))


def interleaved(pools: DataFrame, k: int = Config.k) -> DataFrame:
    """(query_id, rank, chunk_key) from disjoint gated pools: by rank within the pool, then strongest pool first."""
    ordinal = F.create_map(*[x for name, i in _ORD.items() for x in (F.lit(name), F.lit(i))])[F.col("kind")]
    order = Window.partitionBy("query_id").orderBy("pool_rank", F.asc_nulls_last("strength"), ordinal)
    return pools.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_key", "kind", "dist", "score")


def round_robin(pools: list[list[str]], k: int) -> list[str]:
    """Take turns over pools that may overlap; what is taken once is skipped later."""
    out: dict[str, None] = {}
    queues = [iter(p) for p in pools]
    while queues and len(out) < k:
        alive = []
        for q in queues:
            item = next((x for x in q if x not in out), None)
            if item is not None and len(out) < k:
                out[item] = None
                alive.append(q)
        queues = alive
    return list(out)


def _final(rows: pd.DataFrame, k: int, gap: float) -> pd.DataFrame:
    """Gate, interleave and pin for one query: at most 4 pools of ``pool`` rows."""
    dist = rows.dropna(subset=["dist"]).groupby("chunk_key")["dist"].min().to_dict()
    exact = set(rows.loc[[x is True or x is np.True_ for x in rows["exact"]], "chunk_key"])
    pools, pinned = [], None
    for name in ("symbol", *KINDS):
        ranked = rows[rows["pool"] == name].sort_values("pool_rank")["chunk_key"].tolist()
        if pinned is None:
            pinned = next((c for c in ranked if c in exact), None)
        best = min((dist[c] for c in ranked if c in dist), default=np.inf)
        kept = [c for c in ranked if np.isinf(best) or c not in dist or dist[c] <= best + gap]
        pools.append((name != "symbol", best, kept))
    order = round_robin([p for _, _, p in sorted(pools, key=lambda p: (p[0], p[1] if p[0] else 0))], k)
    if pinned is not None:
        order = [pinned, *(c for c in order if c != pinned)]
    order = order[:k]
    return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": range(1, len(order) + 1), "chunk_key": order, "dist": [dist.get(c) for c in order]})


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = Config.k, pool: int = Config.pool, gap: float = Config.relevance_gap, index: DataFrame | KeywordIndex | None = None, dense=dense_hits) -> DataFrame:
    """(query_id, rank, chunk_key, dist): the k best chunks of each query, an exact API page pinned first.

    ``index`` is a kept ``KeywordIndex`` or written ``postings`` of the chunks, made here where none are given;
    ``dense`` is what gives the dense pools (``cells.CellIndex.hits`` for a search in parts).  The pools and
    the chunks with symbols are written once, since queries with and without a symbol both read them.
    """
    words = index.hits(queries, pool) if isinstance(index, KeywordIndex) else keyword_hits(postings(chunks, queries=queries) if index is None else index, queries, pool)
    pools, at = fused(dense(chunks, queries, pool), words), folder(queries.sparkSession, "pools")
    pools.write.parquet(at)
    kinds = queries.sparkSession.read.schema(pools.schema).parquet(at)
    symbols, at = symbol_hits(chunks, queries, pool), folder(queries.sparkSession, "symbols")
    symbols.write.parquet(at)
    symbols = queries.sparkSession.read.schema(symbols.schema).parquet(at)
    named = symbols.select("query_id").distinct()
    plain = interleaved(gated(kinds.join(named, "query_id", "left_anti"), gap), k).select("query_id", "rank", "chunk_key", "dist")
    exact = symbols.select("query_id", "chunk_key", "exact")
    rows = kinds.join(named, "query_id", "left_semi").select("query_id", F.col("kind").alias("pool"), "chunk_key", "dist", "pool_rank").join(exact, ["query_id", "chunk_key"], "left")
    lead = symbols.select("query_id", F.lit("symbol").alias("pool"), "chunk_key", F.lit(None).cast("double").alias("dist"), F.col("symbol_rank").alias("pool_rank"), "exact")
    turns = rows.unionByName(lead).groupBy("query_id").applyInPandas(lambda d: _final(d, k, gap), "query_id string, rank int, chunk_key string, dist double")
    return plain.unionByName(turns)


def search(chunks: DataFrame, queries: DataFrame, k: int = Config.k, **options) -> DataFrame:
    """The search tool: (query_id, rank, url, anchor, title, heading_path, content, dist) of sections with content.

    An unknown kind means every kind; a library or kind that is given restricts every pool.  ``title`` is the
    heading path, or the url where there is none.
    """
    found = retrieve(chunks, queries.withColumn("kind", known_kind(F.col("kind"))), k, **options)
    rows = with_content(found, chunks).where(F.coalesce("content", F.lit("")) != "")
    return rows.select("query_id", "rank", "url", "anchor", F.coalesce(F.nullif("heading_path", F.lit("")), "url").alias("title"), "heading_path", "content", "dist")


def with_content(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Late materialization: pointer columns and content for the keys that are left, in rank order columns."""
    return ranked.join(chunks.drop("embedding", "lexemes"), "chunk_key")


def hydrated(pointers: DataFrame, units: DataFrame) -> DataFrame:
    """Pointers with content: the stored one, else that of the same page's unit with equal headings and part.

    Pointers that find neither drop out; ranks stay as they are.
    """
    live = units.select("url", F.array_join("heading_path", " > ").alias("heading_path"), "part", F.col("content").alias("live")).dropDuplicates(["url", "heading_path", "part"])
    both = pointers.join(live, ["url", "heading_path", "part"], "left").withColumn("content", F.coalesce(F.nullif("content", F.lit("")), F.col("live"))).drop("live")
    return both.where(F.col("content").isNotNull())


def whole_page(pages: DataFrame, units: DataFrame, limit: int = Config.page_chars) -> DataFrame:
    """(url, text): the page's body, or the outline of its headings where it is too long."""
    outline = units.groupBy("url").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.array_join("heading_path", " > ").alias("h")))), lambda x: x["h"])), "\n").alias("outline"))
    return pages.join(outline, "url", "left").select("url", F.when(F.char_length("body") > limit, F.coalesce("outline", F.lit(""))).otherwise(F.col("body")).alias("text"))


def stored_pages(chunks: DataFrame, limit: int = Config.page_chars) -> DataFrame:
    """(url, page_title, text) of every stored page: its chunks in the order of the document, or the outline of
    its headings where that is longer than ``limit``.

    Order is by ordinal and part, ties by key; empty contents leave no gap, a page without content is empty.
    """
    parts = chunks.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part", "chunk_key", "page_title", "heading_path", "content"))).alias("c"))
    body = F.array_join(F.filter(F.transform("c", lambda x: x["content"]), lambda t: t != ""), "\n\n")
    outline = F.array_join(F.array_distinct(F.filter(F.transform("c", lambda x: x["heading_path"]), lambda h: h != "")), "\n")
    return parts.select("url", F.get("c", 0)["page_title"].alias("page_title"), F.when(F.char_length(body) > limit, outline).otherwise(body).alias("text"))


def context_blocks(sections: DataFrame, limit: int = Config.section_chars) -> DataFrame:
    """(query_id, context): numbered sections in rank order, each cut at ``limit`` with a marker."""
    from tessera.functions.text import context_body

    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("heading_path"), F.lit(" ("), F.col("url"), F.lit("#"), F.col("anchor"), F.lit(")\n"))
    block = F.concat(head, context_body(F.col("content"), limit))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n")
    return sections.groupBy("query_id").agg(joined.alias("context"))


def title_previews(sections: DataFrame, n: int = 4) -> DataFrame:
    """(query_id, titles): last breadcrumbs of the first n sections, joined by a middle dot."""
    last = F.element_at(F.split("heading_path", " > "), -1)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", last.alias("t")))), lambda x: x["t"])
    return sections.groupBy("query_id").agg(F.array_join(F.filter(F.slice(rows, 1, n), lambda t: t != ""), " · ").alias("titles"))
