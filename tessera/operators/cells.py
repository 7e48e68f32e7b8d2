"""A vector index of cells for dense search: an inverted file over spherical k-means centres in two levels.

About the square root of the number of cells are coarse centres, fitted on the driver on at most ``SAMPLE`` rows;
the cells of each coarse one are fitted in a task of its own, on a bounded sample, and stay in a table.  So
what the driver and a worker hold grows with the root of the cells.  Every chunk is assigned to the nearest
cell of its nearest coarse one; the index has all rows, by cell.

A query ranks the cells of its nearest coarse ones and looks into the nearest ``probe`` of them.  Neighbouring cells are
searched together, in pieces of bounded size, so a query's hits are its pools of each piece and not of each cell.  Where a filter leaves a pool short the search widens, twice as many cells in
each round, until the pools are full or every cell was looked at; with ``probe`` of all cells the result is exact.
How many cells a search takes by default is measured when the index is built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import KINDS, Config
from tessera.operators.retrieval import _HITS, BLOCK_QUERIES, SHARD_ROWS, _matrix, _unit, dense_hits, nearest, pooled, wants
from tessera.streaming.runs import folder
from tessera.workers import lean, lean_cogroup

#: Rows that coarse centres are fitted on, at most: those with the smallest key hashes.
SAMPLE = 50_000
#: Cells of a coarse centre, at most, and rows that each of them is fitted on.
FINE, FINE_ROWS = 1024, 64
#: Share of exact pools that the default number of cells must hold, and rows that it is measured on.
RECALL, TRIED = 0.95, 64
#: Cells that are searched in one group, at most, and queries that meet a piece of them at once, at most about.
BUNDLE, LOOK_QUERIES = 256, 1 << 12
_SLICE = 1 << 12
_ROUNDS = 8


def _home(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each point's nearest centre, some points at a time."""
    return np.concatenate([np.argmax(np.nan_to_num(points[i : i + _SLICE] @ centres.T), axis=1) for i in range(0, len(points), _SLICE)] or [np.zeros(0, int)])


def kmeans(vectors: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` unit centres, no more than different directions; rows without one are left out."""
    points = _unit(np.array(vectors))
    points = np.unique(points[~np.isnan(points).any(axis=1)], axis=0)
    if not len(points):
        return np.zeros((0, vectors.shape[1]))
    centres = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(_ROUNDS if len(points) > len(centres) else 0):
        sums = np.zeros_like(centres)
        np.add.at(sums, _home(points, centres), points)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    return centres


def _hash(seed: int):
    return F.xxhash64("chunk_key", F.lit(seed))


def _sampled(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """A share of the rows by key hash, the same ones in each run."""
    return rows if share >= 1 else rows.where(_hash(seed) <= int((2 * share - 1) * ((1 << 63) - 1)))


def _shares(counts: dict[int, int], cells: int) -> dict[int, int]:
    """``cells`` over the coarse centres by their counts, one at least and ``FINE`` at most each."""
    total = sum(counts.values())
    exact = {c: cells * n / total for c, n in counts.items()}
    given = {c: max(1, math.floor(x)) for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: given[c] - exact[c])[: max(0, cells - sum(given.values()))]:
        given[c] += 1
    return {c: min(FINE, n) for c, n in given.items()}


def _coarse(rows: DataFrame, vector: str, centres: np.ndarray, n: int) -> DataFrame:
    """``rows`` with ``coarse``, the numbers of the ``n`` nearest coarse centres; 0 first for a vector without a direction."""
    names = rows.columns
    at = names.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _unit(_matrix(pa.chunked_array([b.column(at)])))
            if points.shape[1] != centres.shape[1]:
                points = np.full((b.num_rows, centres.shape[1]), np.nan)
            near = np.argsort(-np.nan_to_num(points @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * near.shape[1], pa.int32()), pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*names, "coarse"])

    return rows.mapInArrow(lean(run), f"{_ddl(rows)}, coarse array<int>")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


class Centres:
    """The coarse centres here, the cells' (cell, coarse, centre) in a table; its length is the number of cells."""

    def __init__(self, coarse: np.ndarray, table: DataFrame, total: int):
        self.coarse, self.table, self.total = coarse, table, total

    def __len__(self) -> int:
        return self.total

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Centres:
        found = spark.read.parquet(f"{path}/coarse").orderBy("coarse").collect()  # about the root of the cells
        table = spark.read.parquet(f"{path}/centres")
        return cls(np.array([r.centre for r in found]) if found else np.zeros((0, 0)), table, table.count())

    def reach(self, probe: int) -> int:
        """Coarse centres whose cells are ranked for ``probe`` of them: four times their share, 4 at least."""
        every = len(self.coarse)
        return every if probe >= self.total else min(every, max(4, math.ceil(4 * probe * every / self.total)))

    def ranked(self, asked: DataFrame, probe: int, blocks: int) -> DataFrame:
        """(query_id, cell, place) of the nearest ``probe`` cells in reach, of ``asked`` with their coarse centres."""
        left = asked.select("query_id", "vector", F.explode(F.slice("coarse", 1, self.reach(probe))).alias("coarse"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
        right = self.table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def run(q: pa.Table, c: pa.Table) -> pa.Table:
            points, centres = _unit(_matrix(q["vector"])), _matrix(c["centre"])
            near = points @ centres.T if points.shape[1] == centres.shape[1] else np.full((len(points), len(centres)), np.nan)
            order = np.argsort(-np.nan_to_num(near), axis=1, kind="stable")[:, :probe]
            ids = q["query_id"].take(pa.array(np.repeat(np.arange(len(points)), order.shape[1])))
            return pa.table({"query_id": ids.combine_chunks(), "cell": c["cell"].take(pa.array(order.reshape(-1))).combine_chunks(), "near": pa.array(np.take_along_axis(near, order, 1).reshape(-1), pa.float64())})

        found = left.groupBy("coarse", "block").cogroup(right.groupBy("coarse", "block")).applyInArrow(lean_cogroup(run), "query_id string, cell int, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell")
        return found.where("not isnan(near)").withColumn("place", F.row_number().over(order)).where(F.col("place") <= probe).select("query_id", "cell", "place")


class CellIndex:
    """Chunks by cell, written below ``path`` and read again by a later session."""

    def __init__(self, rows: DataFrame, centres: Centres, probe: int = 0):
        self.rows, self.centres, self.probe = rows, centres, probe or max(1, len(centres))

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None, seed: int = 3) -> CellIndex:
        """An index of every chunk with a vector; by default about the square root of their number of cells.

        Vectors without a direction, which no search finds, are kept in the first cell.
        """
        spark = chunks.sparkSession
        slim = chunks.where("embedding is not null").select("chunk_key", "kind", "library", "embedding")
        n = slim.count()
        cells = cells or max(1, round(n**0.5))
        first = _sampled(slim, 1.2 * SAMPLE / max(1, n), seed).orderBy(_hash(seed), "chunk_key").limit(SAMPLE).select("embedding").toArrow()
        coarse = kmeans(_matrix(first["embedding"]), math.ceil(cells**0.5), seed)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(coarse)], "coarse int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/coarse")
        share = min(1.0, 2.0 * FINE_ROWS * cells / max(1, n))
        few = _coarse(_sampled(slim, share, seed + 1).select("chunk_key", "embedding"), "embedding", coarse, 1).withColumn("coarse", F.coalesce(F.get("coarse", F.lit(0)), F.lit(0)))
        counts = {r.coarse: r["count"] for r in few.groupBy("coarse").count().collect()}  # one row a coarse centre
        given = _shares(counts, cells) if counts else {}
        starts = dict(zip(sorted(given), np.cumsum([0, *[given[c] for c in sorted(given)]]).tolist(), strict=False))
        order = Window.partitionBy("coarse").orderBy(_hash(seed + 1), "chunk_key")
        few = few.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= FINE * FINE_ROWS).drop("_place")

        def fit(key: tuple, group: pa.Table) -> pa.Table:
            c = key[0].as_py()
            found = kmeans(_matrix(group["embedding"]), given[c], seed)
            return pa.table({"cell": pa.array(np.arange(len(found)) + starts[c], pa.int32()), "coarse": pa.array([c] * len(found), pa.int32()), "centre": pa.array(found.tolist(), pa.list_(pa.float64()))})

        few.groupBy("coarse").applyInArrow(fit, "cell int, coarse int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
        pieces = {c: max(1, math.ceil(2 * m / share / SHARD_ROWS)) for c, m in counts.items()}
        many = F.coalesce(*[F.when(F.col("coarse") == c, m) for c, m in pieces.items() if m > 1], F.lit(1)) if pieces else F.lit(1)
        dealt = _coarse(slim, "embedding", coarse, 1).withColumn("coarse", F.coalesce(F.get("coarse", F.lit(0)), F.lit(0)))
        dealt = dealt.withColumn("many", many).withColumn("piece", F.pmod(F.xxhash64("chunk_key"), F.col("many")).cast("int"))
        table = spark.read.parquet(f"{path}/centres").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce(*[F.when(F.col("coarse") == c, m - 1) for c, m in pieces.items() if m > 1], F.lit(0)))))

        names, ddl = slim.columns, _ddl(slim)

        def keep(rows: pa.Table, c: pa.Table) -> pa.Table:
            return _settled(rows, c, names)

        dealt.groupBy("coarse", "piece").cogroup(table.groupBy("coarse", "piece")).applyInArrow(lean_cogroup(keep), f"{ddl}, cell int").write.mode("overwrite").parquet(f"{path}/rows")
        index = cls(spark.read.parquet(f"{path}/rows"), Centres.load(spark, path))
        spark.createDataFrame([(index.probe_for(RECALL, n, seed + 2),)], "probe int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probe")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        return cls(spark.read.parquet(f"{path}/rows"), Centres.load(spark, path), spark.read.parquet(f"{path}/probe").first().probe)

    def probe_for(self, recall: float, n: int, seed: int, pool: int = Config.pool) -> int:
        """The fewest cells in which at least ``recall`` of the exact pools of ``TRIED`` rows lie.

        The rows are those with the smallest key hashes; each is searched exactly, in one pass over the index, and
        only the places of their hits' cells come here.
        """
        some = _sampled(self.rows.where(F.size("embedding") > 0), 40 * TRIED / max(1, n), seed).orderBy(_hash(seed), "chunk_key").limit(TRIED)
        asked = self.rows.sparkSession.createDataFrame(some.select(F.col("chunk_key").alias("query_id"), F.col("embedding").alias("vector")).toArrow()) if len(self.centres) else None
        if asked is None or asked.isEmpty():
            return max(1, len(self.centres))
        asked = asked.withColumns({"library": F.lit(None).cast("string"), "kind": F.lit(None).cast("string")})
        homes = _coarse(wants(asked), "vector", self.centres.coarse, len(self.centres.coarse))
        hits = dense_hits(self.rows, asked, pool).join(self.rows.select("chunk_key", "cell"), "chunk_key")
        placed = hits.join(self.centres.ranked(homes, len(self.centres), 1), ["query_id", "cell"]).join(self.centres.table.select("cell", "coarse"), "cell")
        placed = placed.join(homes.select("query_id", F.col("coarse").alias("order")), "query_id").select("place", F.array_position("order", F.col("coarse")).alias("near"))
        found = np.array([(r.place, r.near) for r in placed.collect()], int).reshape(-1, 2)  # at most TRIED pools of each kind
        for probe in range(1, len(self.centres)):
            if len(found) and np.mean((found[:, 0] <= probe) & (found[:, 1] <= self.centres.reach(probe))) >= recall:
                return probe
        return len(self.centres)

    def hits(self, chunks: DataFrame | None, queries: DataFrame, pool: int = Config.pool, probe: int | None = None) -> DataFrame:
        """As ``retrieval.dense_hits`` over the index; ``chunks`` is not read and only there for ``retrieve``.

        ``probe`` is the number of cells that each query looks into first, by default as many as ``RECALL`` of
        the exact pools took at the build (unfiltered ones; a filter widens).
        """
        spark, at = self.rows.sparkSession, folder(self.rows.sparkSession, "cells")

        def kept(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{at}/{name}")
            return spark.read.schema(rows.schema).parquet(f"{at}/{name}")

        every, probe = len(self.centres), probe or self.probe
        width = max(1, min(BUNDLE, SHARD_ROWS * every // max(1, self.rows.count())))  # neighbours: cells of a coarse one follow each other
        rows, bundle = self.rows.withColumn("bundle", F.expr(f"cell div {width}")), F.expr(f"cell div {width}").alias("bundle")
        sizes = rows.groupBy("bundle").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("pieces"))
        dealt = rows.join(sizes, "bundle").withColumn("piece", F.pmod(F.xxhash64("chunk_key"), F.col("pieces")).cast("int"))
        asked = kept(_coarse(wants(queries), "vector", self.centres.coarse, max(1, len(self.centres.coarse))), "asked")
        count = asked.count()
        blocks, sets = max(1, -(-count // BLOCK_QUERIES)), max(1, -(-count // LOOK_QUERIES))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
        found, open_, seen, turn = None, asked, None, 0
        while True:
            probe = min(max(1, every), probe)
            new = self.centres.ranked(open_, probe, blocks).drop("place")
            if seen is not None:
                new = new.join(seen, ["query_id", "cell"], "left_anti")
            new = kept(new, f"looks/turn={turn}")
            seen = spark.read.schema("query_id string, cell int").parquet(f"{at}/looks")
            looks = new.groupBy("query_id", bundle).agg(F.collect_list("cell").alias("cells")).join(open_.drop("coarse"), "query_id").join(sizes, "bundle")
            looks = looks.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
            looks = looks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int"))
            here = dealt.groupBy("bundle", "piece", "block").cogroup(looks.groupBy("bundle", "piece", "block")).applyInArrow(lean_cogroup(nearest(pool)), _HITS)
            found = kept(pooled(here if found is None else found.drop("dense_rank").unionByName(here), pool), f"found{turn}")
            if probe >= every:
                return found
            full = found.groupBy("query_id", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= pool).groupBy("query_id").agg(F.count("*").alias("kinds"))
            short = F.coalesce("kinds", F.lit(0)) < F.when(F.col("want_kind").isNull(), len(KINDS)).otherwise(1)
            open_ = asked.join(full, "query_id", "left").where(short).drop("kinds")
            if open_.isEmpty():
                return found
            probe, turn = 2 * probe, turn + 1


def _settled(rows: pa.Table, c: pa.Table, names: list[str]) -> pa.Table:
    """``rows`` with the nearest of the cells ``c``."""
    points, centres = _unit(_matrix(rows["embedding"])), _matrix(c["centre"])
    at = np.zeros(len(points), int)
    if not len(centres):
        return rows.select(names).append_column("cell", pa.array(at, pa.int32()))
    if points.shape[1] == centres.shape[1]:
        at = _home(points, centres)
    return rows.select(names).append_column("cell", c["cell"].take(pa.array(at)).combine_chunks())
