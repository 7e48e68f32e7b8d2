"""Exact top-k search of binary codes by incremental multi-index hashing.

A code's bits fall into m segments of about log2(rows) bits; codes at distance d agree with the query
in some segment up to d / m bits.  The index is one table of (segment, value) for all rows, and search
goes in rounds: round r probes, for every query that is still open, the values at exactly r bits from
its own, segment by segment, as an equi-join.  After step (r, j) every code within m * r + j bits has
been met and verified (Norouzi, Punjani and Fleet, 2012).  A query carries its kth verified distance from
round to round; it skips the segments that distance does not need and leaves when it is covered.
A row is taken at the first step that meets it and at no later one, which its segments tell, so nothing
is verified twice.  Nothing is approximate: recall against brute force is 1.

Of rows with equal codes only the k smallest ids can be among the k nearest, so a code that very many
rows share enters the index k times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace
from tessera.workers import lean

#: Widest segment: at most C(24, r) values are probed at r bits.
WIDEST = 24
_PROBES = 1 << 18  # rows that one task makes of queries
_NONE = -(2**63)


def sign_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", bits: int | None = None) -> DataFrame:
    """(vec_id, code): bit i % 64 of word i / 64 tells whether element i is above 0.

    ``bits`` is the vectors' width, by default that of the longest.  Missing, null and NaN elements
    give 0; a row with a null vector has no code and drops out; a null id stays; an empty table stays empty.
    """
    picked = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    if bits is None:
        bits = picked.agg(F.max(F.size("v"))).first()[0] or 1
    words = -(-max(1, bits) // 64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            on = (flat > 0) & (place < 64 * words)
            code = np.zeros((len(sizes), words), np.uint64)
            np.add.at(code, (row[on], place[on] // 64), weights[place[on] % 64])
            offsets = pa.array(np.arange(len(sizes) + 1) * words, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(code.reshape(-1).view(np.int64)))], names=["vec_id", "code"])

    return picked.mapInArrow(lean(run), "vec_id long, code array<long>")


def segments(used: list[int], n: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment, for words with ``used`` bits and ``n`` rows."""
    aim = min(WIDEST, max(4, round(math.log2(max(2, n)))))
    out = []
    for word, bits in enumerate(used):
        m = max(1, round(bits / aim)) if bits else 0
        edges = [i * bits // m for i in range(m + 1)] if m else []
        out += [(word, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out or [(0, 0, 1)]


def flips(width: int, r: int) -> list[int]:
    """All values of ``width`` bits with ``r`` of them set."""
    return [sum(1 << b for b in c) for c in combinations(range(width), r)]


def _cut(word: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _probes(active: DataFrame, n: int, parts: list[tuple[int, int, int]], r: int, words: list[str]) -> DataFrame:
    """Each of ``n`` open queries (q, kth, words) with the (segment, value) pairs at ``r`` bits that it needs."""
    m, out = len(parts), None
    for wide in sorted({width for _, _, width in parts}):
        masks = flips(wide, r)
        if not masks:
            continue
        own = [F.struct(F.lit(j).alias("j"), _cut(F.col(words[word]), first, width).alias("s")) for j, (word, first, width) in enumerate(parts) if width == wide]
        needed = F.filter(F.array(*own), lambda c: F.col("kth").isNull() | (c["j"] <= F.col("kth") - m * r))
        values = F.from_json(F.lit(str(masks)), "array<bigint>")
        dealt = active.repartition(max(1, -(-n * len(own) * len(masks) // _PROBES)), "q", *words)
        rows = dealt.select("*", F.explode(needed).alias("c")).select("q", "kth", *words, "c.j", F.explode(F.transform(values, lambda x: x.bitwiseXOR(F.col("c.s")))).alias("s"))
        out = rows if out is None else out.unionByName(rows)
    return out


def top_k(index: DataFrame, queries: DataFrame, space: Workspace, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest codes of each query, ties by id.

    ``index`` and ``queries`` have (vec_id, code), codes as arrays of 64-bit words of any number; words
    that are missing count as 0.  A query that is a row of the index finds itself.  Repeated rows of the index
    are results of their own, equal queries are one; a null id comes before others and stays null;
    fewer than k rows give fewer results; an empty table none.
    """
    size = F.max(F.size("code"))
    words = [f"w{i}" for i in range(max(1, *((d.agg(size).first()[0] or 0) for d in (index, queries))))]
    spread = lambda d, name: d.select(F.coalesce("vec_id", F.lit(_NONE)).alias(name), *[F.coalesce(F.get("code", i), F.lit(0)).cast("long").alias(w) for i, w in enumerate(words)])
    same_code = Window.partitionBy(*words).orderBy("id")
    codes = spread(index, "id").withColumn("r", F.row_number().over(same_code)).where(F.col("r") <= k).drop("r")
    codes = space.save(codes, "codes")
    asked = space.save(spread(queries, "q").distinct(), "queries")
    totals = codes.union(asked.toDF("id", *words)).agg(F.count("*"), *[F.bit_or(w) for w in words]).first()
    parts = segments([((x or 0) & (2**64 - 1)).bit_length() for x in totals[1:]], totals[0])
    m = len(parts)
    cells = F.array(*[F.struct(F.lit(j).alias("j"), _cut(F.col(words[word]), first, width).alias("s")) for j, (word, first, width) in enumerate(parts)])
    table = space.save(codes.select("*", F.explode(cells).alias("c")).select("c.j", "c.s", "id", *[F.col(w).alias(f"x{w}") for w in words]), "segments")

    active, n = asked.withColumn("kth", F.lit(None).cast("int")), asked.count()
    best, name = None, ""
    order = Window.partitionBy("q", *words).orderBy("distance", "id")
    for r in range(max(width for _, _, width in parts) + 1):
        # few queries become many probes, which the planner cannot know: never send them to every executor
        hits = _probes(active, n, parts, r, words).hint("merge").join(table.hint("merge"), ["j", "s"])
        apart = [F.bit_count(_cut(F.col(words[word]).bitwiseXOR(F.col(f"x{words[word]}")), first, width)) for word, first, width in parts]
        fresh = F.lit(True)
        for i, d in enumerate(apart):
            fresh &= (F.col("j") == i) | (d > F.lit(r) - (F.col("j") < i).cast("int"))
        distance = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"x{w}"))) for w in words), F.lit(0)).cast("int")
        found = hits.where(fresh).select("q", *words, "id", distance.alias("distance"), "kth").where("kth is null or distance <= kth").drop("kth")
        every = found if best is None else best.drop("rank").unionByName(found)
        best = space.save(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"best-{r}")
        if name:
            space.drop(name, f"open-{r - 1}")
        name = f"best-{r}"
        # full and covered: the kth distance is at most what the steps so far have met
        so_far = best.groupBy("q", *words).agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        rest = asked.join(so_far, ["q", *words], "left").where(F.coalesce((F.col("n") < k) | (F.col("far") > m * (r + 1) - 1), F.lit(True)))
        active = space.save(rest.select("q", *words, F.when(F.col("n") >= k, F.col("far")).alias("kth")), f"open-{r}")
        n = active.count()
        if not n:
            break
    space.drop("segments", "codes", "queries")
    known = lambda c: F.nullif(F.col(c), F.lit(_NONE))
    return best.select(known("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("vec_id"), "distance")


ORACLE = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: CAST((p[1] > 0) <> (p[2] > 0) AS INT))) AS INT) AS distance
  FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
