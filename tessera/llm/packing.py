"""Packing token ids into fixed windows by non-negative least squares over length histograms.

1. Every document's ids are cut into full windows and one remainder.  Lengths go into bins of
   ``window / 256`` ids (rounded up), whose global histogram is counted in Spark.
2. All combinations of up to three bins that fill a window exactly are enumerated; non-negative
   least squares finds repeat counts whose use of bins matches the histogram; counts are rounded
   down to what is there, and residual pieces are packed greedily by the same combinations.
3. A piece finds its combination from its rank within its bin, which takes levels: a rank within
   (partition, bin) and running counts over partitions.  No bin is gathered in one task, however
   many documents share a length.
4. What no combination takes is laid end to end and cut at window borders; the last, partial
   window is cut at powers of two, where nothing is padded.  Places are running sums in levels:
   within groups of pieces, over the groups of a partition, over partitions.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import Encoder
from tessera.llm.workspace import Workspace
from tessera.workers import lean

BINS = 256
#: Pieces of a group, and sums that one task of a running total takes at once.
GROUP, STEP = 64, 1024


def combinations(bins: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` bins that add up to ``bins``, largest first in each."""
    out: list[tuple[int, ...]] = [(bins,)]
    for k in range(2, depth + 1):
        for low in combinations_with_replacement(range(1, bins // k + 1), k - 1):
            top = bins - sum(low)
            if top >= low[-1]:
                out.append((top, *reversed(low)))
    return out


def nnls(columns: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |columns @ x - target| (Lawson and Hanson's active sets).

    It ends where no column's inner product with the residual exceeds ``tolerance`` times the largest
    target.  Sets do not come back in exact arithmetic; should rounding make them, the loop ends after
    three steps a column with what it has, which costs padding and nothing else.
    """
    x, active = np.zeros(columns.shape[1]), np.zeros(columns.shape[1], bool)
    scale = max(1.0, float(np.abs(target).max()))
    for _ in range(3 * columns.shape[1]):
        gain = columns.T @ (target - columns @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance * scale:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            sub = columns[:, on]
            z = np.linalg.solve(sub.T @ sub + 1e-10 * np.eye(len(on)), sub.T @ target)
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            cur = x[on]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(low, cur / np.maximum(cur - z, 1e-300), np.inf).min()
            x[on] = cur + min(1.0, step) * (z - cur)
            drop = on[(x[on] <= 1e-12 * scale) & low]
            if len(drop) == 0:
                drop = on[low][:1]
            x[drop] = 0
            active[drop] = False
    return x


def plan(histogram: np.ndarray, bins: int = BINS, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): never more pieces of a bin than ``histogram`` has."""
    combos = combinations(bins, depth)
    matrix = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        for b in c:
            matrix[b - 1, j] += 1
    left = histogram.astype(np.int64).copy()
    whole, left[bins - 1] = int(left[bins - 1]), 0
    out = [(combos[0], whole)] if whole else []
    # counts are rounded down to whole repeats, so a hundredth of a piece is near enough
    x = nnls(matrix[: bins - 1, 1:], left[: bins - 1].astype(float), 0.01 / max(1, int(left.max()))) if left.any() else np.zeros(len(combos) - 1)
    solved = [j + 1 for j in np.argsort(-x, kind="stable") if x[j] >= 1]
    for order, most in ((solved, x), (range(1, len(combos)), None)):  # the rounded solution, then what is left
        for j in order:
            c = combos[j]
            n = min(left[b - 1] // c.count(b) for b in c)
            if most is not None:
                n = min(n, int(most[j - 1] + 1e-6))
            if n > 0:
                out.append((c, int(n)))
                for b in c:
                    left[b - 1] -= n
    return out


def pieces(docs: DataFrame, path: str, end_id: int, window: int, key: str = "doc_id", text: str = "text", literal: bool = True) -> DataFrame:
    """Tokenize, cut at full windows, and number pieces within (partition, bin); ``part`` and ``k`` name a piece."""
    names = ["part", "k", "doc_id", "start", "length", "doc_tokens", "bin", "rank", "ids"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    width = max(1, window // BINS)
    tail = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, seen = TaskContext.get().partitionId(), 0, [0] * (BINS + 2)
        encoder = Encoder.of(path, literal)
        for b in batches:
            keys = b.column(0).to_pylist()
            for at, to, found in encoder.column(b.column(1), tail):
                rows = []
                for doc, ids in zip(keys[at:to], found, strict=True):
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        bin_ = -(-length // width)
                        rows.append((part, k, doc, start, length, n, bin_, seen[bin_], ids[4 * start : 4 * (start + length)]))
                        seen[bin_] += 1
                        k += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run, "tokens"), "part int, k long, doc_id long, start long, length long, doc_tokens long, bin int, rank long, ids binary")


def _assign(found: list[tuple[tuple[int, ...], int]]):
    """(bin, rank) to (sequence, slot) by binary search in the ranges that the plan gives to each bin."""
    used, rows, sequence = {}, [], 0
    for combo, n in found:
        for slot, b in enumerate(combo):
            rows.append((b, used.get(b, 0), n, sequence, slot))
            used[b] = used.get(b, 0) + n
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rank = (d["rank"] + d["before"]).to_numpy(np.int64)
            bin_ = d["bin"].to_numpy(np.int64)
            sequence_id, slot = np.full(len(d), -1, np.int64), np.zeros(len(d), np.int32)
            if len(keys):
                at = np.maximum(np.searchsorted(keys, (bin_ << 48) + rank, "right") - 1, 0)
                hit = table[at]
                ok = (hit[:, 0] == bin_) & (rank >= hit[:, 1]) & (rank < hit[:, 1] + hit[:, 2])
                sequence_id[ok] = (hit[:, 3] + rank - hit[:, 1])[ok]
                slot[ok] = hit[ok, 4]
            yield d[["part", "k", "length"]].assign(sequence_id=sequence_id, slot=slot)

    return run, sequence


def _lay(window: int, total: int, first: int):
    """Cut pieces laid end to end at window borders, and in the last window at powers of two."""
    last = total // window * window
    borders, at = [], last
    for bit in range(window.bit_length(), -1, -1):
        if (total - last) >> bit & 1:
            borders.append(at)
            at += 1 << bit
    borders = np.array(borders or [last], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for part, k, length, pos in d[["part", "k", "length", "pos"]].itertuples(index=False):
                at, end = pos, pos + length
                while at < end:
                    if at < last:
                        sequence, begin = at // window, at // window * window
                        border = begin + window
                    else:
                        i = int(np.searchsorted(borders, at, "right")) - 1
                        sequence, begin = last // window + i, int(borders[i])
                        border = int(borders[i + 1]) if i + 1 < len(borders) else total
                    to = min(end, border)
                    rows.append((part, k, at - pos, to - at, first + sequence, at - begin))
                    at = to
            yield pd.DataFrame(rows, columns=["part", "k", "skip", "length", "sequence_id", "offset"])

    return run


def _before(sums: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, order, before): the sum of ``value`` over the earlier rows of each group, in two levels, so
    that a task orders ``STEP`` rows or one sum of these each."""
    ahead = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = sums.withColumn("_step", F.floor(F.col(order) / STEP))
    steps = wide.groupBy(*by, "_step").agg(F.sum(value).alias(value))
    steps = steps.select(*by, "_step", ahead(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_step")).alias("_base"))
    own = wide.select(*by, "_step", order, ahead(Window.partitionBy(*by, "_step").orderBy(order)).alias("_own"))
    return own.join(steps, [*by, "_step"]).select(*by, order, (F.col("_base") + F.col("_own")).alias("before"))


def pack(docs: DataFrame, space: Workspace, tokenizer: str, end_id: int = 1, window: int = 2048, key: str = "doc_id", text: str = "text", literal: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row a piece.

    A null or empty text is a piece of ``end_id`` alone; a null key stays null; repeated rows are
    documents of their own; an empty table gives no pieces.  Only the histogram (256 rows) and one
    total reach the driver.
    """
    whole = space.save(pieces(docs, tokenizer, end_id, window, key, text, literal), "pieces")
    slim = whole.select("part", "k", "length", "bin", "rank")
    before = _before(slim.groupBy("bin", "part").agg(F.count("*").alias("n")), ["bin"], "part", "n")
    histogram = np.zeros(BINS, np.int64)
    for r in slim.groupBy("bin").agg(F.count("*").alias("n")).collect():
        histogram[r.bin - 1] = r.n
    run, sequences = _assign(plan(histogram))
    placed = slim.join(before, ["bin", "part"]).mapInPandas(lean(run), "part int, k long, length long, sequence_id long, slot int")
    placed = space.save(placed, "placed")

    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.where("sequence_id >= 0").select("part", "k", F.lit(0).cast("long").alias("skip"), "length", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))

    loose = placed.where("sequence_id < 0").withColumn("group", F.floor(F.col("k") / GROUP))
    sums = space.save(loose.groupBy("part", "group").agg(F.sum("length").alias("n")), "sums")
    by_part = sums.groupBy("part").agg(F.sum("n").alias("n"))
    total = by_part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    base = _before(sums, ["part"], "group", "n").join(_before(by_part, [], "part", "n").withColumnRenamed("before", "ahead"), "part")
    within = Window.partitionBy("part", "group").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    laid = loose.select("part", "group", "k", "length", F.coalesce(F.sum("length").over(within), F.lit(0)).alias("upto")).join(base, ["part", "group"])
    laid = laid.select("part", "k", "length", (F.col("ahead") + F.col("before") + F.col("upto")).alias("pos")).mapInPandas(lean(_lay(window, int(total), sequences)), "part int, k long, skip long, length long, sequence_id long, offset long")

    every = fitted.unionByName(laid)
    joined = whole.select("part", "k", "doc_id", "start", "doc_tokens", "ids").join(every, ["part", "k"])
    cut = F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * length as int))")
    return joined.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), "length", "doc_tokens", "sequence_id", "offset", cut.alias("ids"))
