"""Connected components by alternating large-star and small-star rounds, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, space: Workspace, label: str = "cc") -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of ``edges`` (a, b).

    Minima are aggregated before the shuffle.  They are joined back to the edges by node; the edges of
    a node with very many neighbours are what adaptive execution splits such a join at, for nothing
    behind the join needs them together.  Every round is a written table; only the last one stays.
    """
    now = space.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-0")
    mark, k = _mark(now), 0
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y")).where("x <> y").union(low.toDF("x", "y"))
        k += 1
        now = space.save(small.toDF("a", "b").distinct(), f"{label}-{k}")
        space.drop(f"{label}-{k - 1}")
        before, mark = mark, _mark(now)
        if mark == before:
            return now.toDF("node", "root").union(now.select("b", "b").distinct())
