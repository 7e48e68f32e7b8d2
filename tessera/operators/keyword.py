"""A kept keyword index: positional postings in blocks with maxima, and ranked search that skips blocks.

The rank of a chunk is the sum over the query's lexemes of ``impact``: tf / (tf + 1) / (1 + ln n), with tf the
lexeme's count and n the number of lexemes of the chunk, in millionths rounded down, so sums are exact and ties
are real.  It looks at the chunk alone, so postings never change with the rest of the corpus.

Chunks lie in blocks of one kind and nearly one length (a quarter of an octave), because length bounds the
impact; a block has at most about ``BLOCK_ROWS`` chunks and ``BLOCK_WORDS`` lexemes, or one longer chunk.
All lexemes share these blocks, so the sum of a block's maxima bounds every chunk in it, and a block without
one of the lexemes is never read.  Equal asks (lexemes, library, kind) are searched once for all their
queries.  A search looks at each one's blocks by falling bound, four times as many in each round, until no bound reaches the last score of a full pool.  Ties at that score are looked at.

Changes write a segment: postings of new and changed chunks, and the keys that earlier segments lose.  A
segment counts once its last table is whole; a failed one is never read.  One writer at a time.

Keys are unique and not null, as in the store; a null kind counts as the empty one; chunks without lexemes
have no postings; null lexemes are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.streaming.runs import folder
from tessera.workers import lean_group

BLOCK_ROWS = 256
BLOCK_WORDS = 1 << 20
UNIT = 1_000_000
_TABLES = ("blocks", "heads", "dead")
_BLOCK = ["segment", "kind", "block"]


def impact(tf: Column, n: Column) -> Column:
    """One lexeme's part of the rank, in millionths."""
    return F.floor(F.lit(float(UNIT)) * tf / (tf + 1) / (1 + F.log(n.cast("double")))).cast("long")


def _blocked(chunks: DataFrame, staged: str, block_rows: int) -> DataFrame:
    """(chunk_key, kind, library, words, n, block), from rows that are written once to ``staged``: counting, sampling
    ranges and making postings read them, not what the chunks come from.  The counts that cut lengths into blocks are one row a kind
    and quarter octave."""
    rows = chunks.select("chunk_key", F.coalesce("kind", F.lit("")).alias("kind"), "library", F.filter("lexemes", lambda w: w.isNotNull()).alias("words"))
    rows = rows.withColumn("n", F.size("words")).where("n > 0").withColumn("span", F.floor(F.log2("n") * 4).cast("int"))
    rows.write.option("compression", "zstd").parquet(staged)
    rows = chunks.sparkSession.read.schema(rows.schema).parquet(staged)
    room = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_WORDS) / F.pow(F.lit(2.0), (F.col("span") + 1) / 4))))
    cuts = rows.groupBy("kind", "span").agg(F.count("*").alias("rows")).select("kind", "span", F.ceil(F.col("rows") / room).alias("cuts"))
    part = F.pmod(F.xxhash64("chunk_key"), F.col("cuts"))
    return rows.join(F.broadcast(cuts), ["kind", "span"]).withColumn("block", F.shiftleft(F.col("span").cast("long"), 40) + part).drop("span", "cuts")


def _grouped(block: pa.Table) -> pa.Table:
    """The ``_blocked`` rows of one block as one row a lexeme: its items by key, and of each its places counted from 1."""
    block = block.take(pc.sort_indices(block["chunk_key"])).combine_chunks()
    words = block["words"].chunk(0)
    of = pc.list_parent_indices(words).to_numpy()
    at = np.arange(len(of)) - np.searchsorted(of, of) + 1
    coded = words.flatten().dictionary_encode()
    sorted_names = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(sorted_names), np.int64)
    rank[sorted_names.to_numpy()] = np.arange(len(rank))
    pair = rank[coded.indices.to_numpy()] * len(block) + of
    order = np.argsort(pair, kind="stable")
    item = np.flatnonzero(np.diff(pair[order], prepend=-1))
    lexeme = pair[order][item] // len(block)
    first = np.flatnonzero(np.diff(lexeme, prepend=-1))
    ends = lambda starts, n: pa.array(np.append(starts, n), pa.int32())
    whose = pa.array(of[order][item])
    tf = pa.array(np.diff(np.append(item, len(order))), pa.int64())
    items = pa.StructArray.from_arrays([*[block[c].chunk(0).take(whose) for c in ("chunk_key", "library", "n")], tf], names=["chunk_key", "library", "n", "tf"])
    places = pa.ListArray.from_arrays(ends(item, len(order)), pa.array(at[order], pa.int32()))
    rows = pa.array(np.zeros(len(first), np.int64))
    return pa.table({
        "lexeme": coded.dictionary.take(sorted_names), "kind": block["kind"].take(rows), "block": block["block"].take(rows),
        "items": pa.ListArray.from_arrays(ends(first, len(item)), items), "positions": pa.ListArray.from_arrays(ends(first, len(item)), places),
    })


def positional(blocked: DataFrame) -> DataFrame:
    """(lexeme, kind, block, items, positions) of ``_blocked`` rows.

    A block's chunks meet in one group of bounded size, which makes all its postings: words are shuffled once and
    postings never; a frequent lexeme spreads over its blocks.
    """
    ddl = "lexeme string, kind string, block long, items array<struct<chunk_key:string,library:string,n:int,tf:long>>, positions array<array<int>>"
    return blocked.groupBy("kind", "block").applyInArrow(lean_group(_grouped), ddl)


class KeywordIndex:
    """Segments of postings below ``path``: ``build`` once, ``change`` after each change of the store; ``KeywordIndex(spark, path)``
    is one that was written before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> KeywordIndex:
        """An index of (chunk_key, kind, library, lexemes) in an empty folder."""
        index = cls(chunks.sparkSession, path)
        index._write(chunks, chunks.select("chunk_key").where(F.lit(False)), block_rows)
        return index

    def change(self, chunks: DataFrame, gone: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> None:
        """New and changed chunks, and the keys (chunk_key) of those that went; no other posting is read or written."""
        keys = chunks.select("chunk_key")
        self._write(chunks, keys if gone is None else keys.unionByName(gone.select("chunk_key")), block_rows)

    def _write(self, chunks: DataFrame, dead: DataFrame, block_rows: int) -> None:
        number = 1 + max((n for t in _TABLES for n in self._segments(t, whole=False)), default=0)
        staged = f"{self.path}/staged/segment={number}"
        rows = _blocked(chunks.select("chunk_key", "kind", "library", "lexemes"), staged, block_rows)
        one = lambda x: F.struct(x["chunk_key"].alias("chunk_key"), x["library"].alias("library"), x["tf"].alias("tf"), impact(x["tf"], x["n"]).alias("impact"))
        split = positional(rows).select("lexeme", "kind", "block", F.transform("items", one).alias("items"), "positions")
        at = {t: f"{self.path}/{t}/segment={number}" for t in _TABLES}
        split.write.parquet(at["blocks"])
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        written = self.spark.read.parquet(at["blocks"])
        parts = F.col("items.impact")
        written.select("lexeme", "kind", "block", F.size(parts).cast("long").alias("postings"), F.array_max(parts).alias("top")).write.parquet(at["heads"])
        dead.distinct().write.parquet(at["dead"])

    def _segments(self, name: str, whole: bool = True) -> list[int]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        child = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in files.listStatus(place)]
        return sorted(int(p.getName().split("=")[1]) for p in found if not whole or files.exists(child(p, "_SUCCESS")))

    def _table(self, name: str) -> DataFrame:
        live = self._segments("dead")
        if not live:
            raise FileNotFoundError(f"no whole segment below {self.path}")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={n}" for n in live])

    def postings(self) -> DataFrame:
        """(lexeme, chunk_key, kind, library, tf, impact, positions) of all chunks that are there."""
        rows = self._table("blocks").withColumn("both", F.explode(F.arrays_zip("items", "positions")))
        return self._alive(rows.select("segment", "lexeme", "kind", "both.items.*", "both.positions")).drop("segment")

    def _alive(self, rows: DataFrame) -> DataFrame:
        if len(self._segments("dead")) == 1:
            return rows
        dead = self._table("dead").groupBy("chunk_key").agg(F.max("segment").alias("until")).alias("dead")
        return rows.alias("row").join(dead, (F.col("row.chunk_key") == F.col("dead.chunk_key")) & (F.col("row.segment") < F.col("dead.until")), "left_anti")

    @staticmethod
    def _wanted(queries: DataFrame) -> DataFrame:
        words = F.array_sort(F.array_distinct(F.filter("query_lexemes", lambda w: w.isNotNull())))
        return queries.select("query_id", F.col("library").alias("want_library"), F.col("kind").alias("want_kind"), words.alias("words"))

    @classmethod
    def _asked(cls, queries: DataFrame) -> DataFrame:
        """A row a distinct ask (lexemes, library, kind) and lexeme; the least id of its queries names it."""
        rows = cls._wanted(queries).groupBy("want_library", "want_kind", "words").agg(F.min("query_id").alias("query_id"))
        return rows.select("query_id", "want_library", "want_kind", F.size("words").alias("need"), F.explode("words").alias("lexeme"))

    @classmethod
    def _members(cls, queries: DataFrame) -> DataFrame:
        """(query_id, ask): each query and the name of its ask, so that equal ones are searched once."""
        rows, by = cls._wanted(queries), ("want_library", "want_kind", "words")
        first = rows.groupBy(*by).agg(F.min("query_id").alias("ask"))
        return rows.alias("q").join(first.alias("a"), [F.col(f"q.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by]).select("query_id", "ask")

    @staticmethod
    def _of_each(members: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` of asks as rows of all their queries."""
        return members.join(rows.withColumnRenamed("query_id", "ask"), "ask").select(*rows.columns)

    def _heads(self, asked: DataFrame) -> DataFrame:
        return self._table("heads").join(asked, "lexeme").where(F.col("want_kind").isNull() | (F.col("kind") == F.col("want_kind")))

    def search(self, queries: DataFrame, pool: int = Config.pool, first: int = 4) -> tuple[DataFrame, DataFrame]:
        """The ``pool`` best chunks of each query and kind that have all its lexemes, and what was read for them.

        The first is (query_id, kind, chunk_key, score, keyword_rank, segment, block), ties by key; the second
        (query_id, kind, blocks, postings), with blocks and postings that were looked at.  Ids of queries are
        unique; a query without lexemes finds nothing.
        """
        at = folder(self.spark, "keyword")

        def kept(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{at}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{at}/{name}")

        members, asked = kept(self._members(queries), "members"), kept(self._asked(queries), "asked")
        whole = self._heads(asked).groupBy("query_id", "want_library", "need", *_BLOCK).agg(F.count("*").alias("have"), F.sum("top").alias("bound"), F.sum("postings").alias("postings")).where("have = need").drop("have")
        by_bound = Window.partitionBy("query_id", "kind").orderBy(F.desc("bound"), "segment", "block")
        bounds = kept(whole.withColumn("place", F.row_number().over(by_bound)), "bounds")
        found, low, high, turn = None, 0, first, 0
        while True:
            left = bounds.where(F.col("place") > low)
            if found is not None:
                edge = found.groupBy("query_id", "kind").agg(F.count("*").alias("full"), F.min("score").alias("edge")).where(F.col("full") >= pool)
                left = left.join(edge, ["query_id", "kind"], "left").where(F.col("edge").isNull() | (F.col("bound") >= F.col("edge"))).drop("full", "edge")
            looks = kept(left.where(F.col("place") <= high), f"looks/turn={turn}")
            if found is not None and looks.isEmpty():
                break
            wanted = looks.select("query_id", "want_library", "need", *_BLOCK).join(asked.select("query_id", "lexeme"), "query_id")
            scored = self._scored(kept(wanted, f"wanted{turn}"))
            if found is not None:
                scored = scored.unionByName(found.drop("keyword_rank"))
            order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "chunk_key")
            found = kept(scored.withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= pool), f"found{turn}")
            low, high, turn = high, 4 * high, turn + 1
        read = self.spark.read.schema(bounds.schema).parquet(f"{at}/looks").groupBy("query_id", "kind").agg(F.count("*").alias("blocks"), F.sum("postings").alias("postings"))
        return self._of_each(members, found), self._of_each(members, read)

    def _scored(self, wanted: DataFrame) -> DataFrame:
        """(query_id, kind, chunk_key, score, segment, block): all that match in the lexemes' blocks of ``wanted``."""
        rows = self._table("blocks").select("lexeme", *_BLOCK, "items").join(wanted, ["lexeme", *_BLOCK])
        rows = rows.select("query_id", "want_library", "need", *_BLOCK, F.explode("items").alias("item")).where(F.col("want_library").isNull() | (F.col("item.library") == F.col("want_library")))
        sums = rows.groupBy("query_id", "need", *_BLOCK, F.col("item.chunk_key").alias("chunk_key")).agg(F.count("*").alias("have"), F.sum("item.impact").alias("score"))
        return self._alive(sums.where("have = need")).select("query_id", "kind", "chunk_key", "score", "segment", "block")

    def hits(self, queries: DataFrame, pool: int = Config.pool) -> DataFrame:
        """As ``retrieval.keyword_hits``, by this rank."""
        return self.search(queries, pool)[0].drop("segment", "block")

    def postings_of(self, queries: DataFrame) -> DataFrame:
        """(query_id, kind, postings): what a search of everything reads."""
        rows = self._heads(self._asked(queries)).groupBy("query_id", "kind").agg(F.sum("postings").alias("postings"))
        return self._of_each(self._members(queries), rows)

    def closeness(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        """``found`` of ``search`` with ``gap``: places between the nearest two different lexemes of the query in
        the chunk; NULL for a query of one lexeme."""
        at, members = folder(self.spark, "closeness"), self._members(queries)
        hits = found.join(members, "query_id").select(F.col("ask").alias("query_id"), *_BLOCK, F.col("chunk_key").alias("key")).distinct()
        hits = hits.join(self._asked(queries).select("query_id", "lexeme"), "query_id")
        hits.write.parquet(at)
        rows = self._table("blocks").join(self.spark.read.schema(hits.schema).parquet(at), ["lexeme", *_BLOCK])
        both = rows.select("query_id", "key", "lexeme", F.explode(F.arrays_zip("items", "positions")).alias("both")).where(F.col("both.items.chunk_key") == F.col("key"))
        places = both.select("query_id", F.col("key").alias("chunk_key"), "lexeme", F.explode("both.positions").alias("at"))
        order = Window.partitionBy("query_id", "chunk_key").orderBy("at")
        step = F.when(F.lag("lexeme").over(order) != F.col("lexeme"), F.col("at") - F.lag("at").over(order))
        gaps = places.withColumn("step", step).groupBy("query_id", "chunk_key").agg(F.min("step").alias("gap"))
        return found.join(self._of_each(members, gaps), ["query_id", "chunk_key"], "left")
