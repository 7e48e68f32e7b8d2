"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Layout of a written folder (all parts are Parquet containers, so that Spark's committed
writer makes them safe against lost executors and they lie in any store Spark writes):

``codebook``   (id, bits): the code length of each id that occurs; codes are canonical.
``blocks``     one row a block: whole documents in ascending key order within a shard, shards
               in ascending key order.  ``payload`` holds each document's bits from a byte
               border on; ``marks`` holds the bit offset of every ``MARK``-th id of each
               document, from where decoding can start; ``doc_ids`` and ``counts`` tell
               whose ids they are.  A block needs no other block.

Building: one global count of ids (bounded by the vocabulary), package-merge on the driver,
then one shuffle of the coded documents by key range.  Ranges follow from the number of ids, and
their borders from a bounded sample of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.llm.ranges import borders
from tessera.llm.workspace import Workspace, shuffle_width
from tessera.workers import lean

MARK = 512
BLOCK_IDS = 1 << 17
SHARD_IDS = 1 << 22


def limited_lengths(counts: np.ndarray, limit: int = 20) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.uint8)
    if n == 1:
        return np.ones(1, np.uint8)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    # rows[d] tells of each item of list d, in weight order, whether it is a leaf
    rows, packed = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packed])
        leaf = np.concatenate([np.ones(n, bool), np.zeros(len(packed), bool)])
        by = np.argsort(weights, kind="stable")
        weights, leaf = weights[by], leaf[by]
        rows.append(leaf)
        even = len(weights) // 2 * 2
        packed = weights[0:even:2] + weights[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(rows):
        used = int(leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of ids: by length, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[by].astype(np.int64), lengths[by].astype(np.int64)
        self.width = int(self.lengths[-1]) if len(by) else 1
        step = np.left_shift(1, self.width - self.lengths)
        first = np.concatenate([[0], np.cumsum(step)])[:-1] if len(by) else np.zeros(0, np.int64)
        self.codes = np.right_shift(first, self.width - self.lengths)
        size = int(self.ids.max()) + 1 if len(by) else 1
        self.bits_of, self.code_of = np.zeros(size, np.uint8), np.zeros(size, np.uint32)
        self.bits_of[self.ids], self.code_of[self.ids] = self.lengths, self.codes
        # the decoding table: the next ``width`` bits give the id and its length
        self.table = np.ones(1 << self.width, np.int64)  # id << 5 | length
        self.table[: int(step.sum())] = np.repeat(self.ids << 5 | self.lengths, step)
        if size <= 1 << 26:
            self.table = self.table.astype(np.int32)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Payload of documents of ``counts`` ids, its byte offsets by document, the bit where each id is."""
        bits = self.bits_of[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(bits, out=upto[1:])
        opened = upto[np.concatenate([[0], np.cumsum(counts)])]
        offsets = np.concatenate([[0], np.cumsum((np.diff(opened) + 7) // 8)])
        at = upto[:-1]
        at += np.repeat(offsets[:-1] * 8 - opened[:-1], counts)
        out = np.zeros(int(offsets[-1]) // 4 + 2, np.uint32)
        if len(ids):
            word = (at >> 5).astype(np.int32)
            value = self.code_of[ids].astype(np.uint64) << (np.uint8(64) - (at & 31).astype(np.uint8) - bits)
            head = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            sums = np.add.reduceat(value, head)  # codes do not overlap: bits add up without a carry
            out[word[head]] += (sums >> np.uint64(32)).astype(np.uint32)
            out[word[head] + 1] += sums.astype(np.uint32)
        return out.astype(">u4").tobytes()[: int(offsets[-1])], offsets, at

    def decode(self, payload: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of segments that start at bit ``starts`` and have ``counts`` ids, one after the other.

        All segments advance together: each round looks up one id in every one.
        """
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # 32 bits from each byte on
        out = np.zeros(int(counts.sum()), np.uint32)
        by = np.argsort(-counts, kind="stable")
        place = np.concatenate([[0], np.cumsum(counts)])[:-1][by]
        at, left = starts[by].astype(np.int64), counts[by]
        drop = np.uint32(32 - self.width)
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, "left"))  # those with more than k ids
            p = at[:n]
            key = (windows[p >> 3] << (p & 7).astype(np.uint32)) >> drop
            entry = self.table[key]
            out[place[:n] + k] = entry >> 5
            p += entry & 31
        return out


def token_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends one row an id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in _id_groups(b.column(0)):
                part = np.bincount(ids)
                if len(part) > len(total):
                    part, total = total, part
                total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _id_groups(column: pa.Array, limit: int = 1 << 22) -> Iterator[np.ndarray]:
    data, offsets = arrays.text_buffers(column)
    for a, b in arrays.slices(offsets, limit):
        yield data[offsets[a] : offsets[b]].view("<u4")


def _coded(tokens: DataFrame, book: Codebook, bounds: np.ndarray) -> DataFrame:
    """Each document's bits and marks, with the shard that its key falls into; null keys come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, (data, ends) = b.column(0), arrays.text_buffers(b.column(1))
            for at, to in arrays.slices(ends, 1 << 20):
                counts = np.diff(ends[at : to + 1]) // 4
                payload, offsets, places = book.encode(data[ends[at] : ends[to]].view("<u4"), counts)
                first = np.concatenate([[0], np.cumsum(counts)])
                key = keys.slice(at, to - at)
                filled = key.fill_null(0).to_numpy(zero_copy_only=False)
                shard = np.searchsorted(bounds, filled, "right")
                shard[~key.is_valid().to_numpy(zero_copy_only=False)] = 0
                bits = [payload[offsets[i] : offsets[i + 1]] for i in range(to - at)]
                marks = [(places[first[i] : first[i + 1] : MARK] - 8 * offsets[i]).astype("<u8").tobytes() for i in range(to - at)]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), key, pa.array(counts, pa.int64()), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())], names=["shard", "doc_id", "n", "bits", "marks"])

    return tokens.select("doc_id", "ids").mapInArrow(lean(run), "shard int, doc_id long, n long, bits binary, marks binary")


def _blocks(coded: DataFrame) -> DataFrame:
    """Whole documents into blocks, in the order they come; a block never spans shards."""
    names = ["shard", "block", "first", "n_ids", "doc_ids", "counts", "marks", "payload"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, held = None, 0, 0, []

        def emit():
            size, marks = 0, []
            for _, _, bits, m in held:
                marks.append(np.frombuffer(m, "<u8") + size * 8)
                size += len(bits)
            row = [shard, block, first, sum(h[1] for h in held), [h[0] for h in held], [h[1] for h in held], np.concatenate(marks).astype("<u8").tobytes(), b"".join(h[2] for h in held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for b in batches:
            for s, key, n, bits, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (s != shard or sum_ids + n > BLOCK_IDS):
                    yield emit()
                    block, first, held = (block + 1, first + sum_ids, []) if s == shard else (0, 0, [])
                if not held:
                    sum_ids = 0
                    if s != shard:
                        block = first = 0
                shard = s
                held.append((key, n, bits, marks))
                sum_ids += n
        if held:
            yield emit()

    return coded.mapInArrow(lean(run), "shard int, block int, first long, n_ids long, doc_ids array<long>, counts array<long>, marks binary, payload binary")


def write_tokens(tokens: DataFrame, space: Workspace, max_bits: int = 18) -> str:
    """Write (doc_id, n_tokens, ids) in ascending doc_id order; returns the folder.

    Null keys come first; equal keys are ordered by their bits, so that the order is defined.  A null
    ``ids`` is an empty document; an empty table gives empty files.
    ``tokens`` is read four times (id counts, row count, key sample, codes): pass a written table.
    """
    spark = tokens.sparkSession
    rows = token_counts(tokens).collect()  # at most one row an id of the vocabulary
    ids, n = np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    book = Codebook(ids, limited_lengths(n, max_bits))
    space.save(spark.createDataFrame([(int(i), int(b)) for i, b in zip(book.ids, book.lengths, strict=True)], "id int, bits int"), "codebook")
    bounds = borders(tokens, "doc_id", max(shuffle_width(spark), -(-int(n.sum()) // SHARD_IDS)), tokens.count())
    ordered = _coded(tokens, book, bounds).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "n", "bits")
    space.save(_blocks(ordered), "blocks", "lz4")
    return space.path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a written folder, from its blocks alone."""
    pairs = spark.read.parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    book = Codebook(np.array([r.id for r in pairs], np.int64), np.array([r.bits for r in pairs], np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row a shard
    base, upto = {}, 0
    for s in sorted(sizes):
        base[s], upto = upto, upto + sizes[s]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decoded(held):
            counts = np.concatenate([np.array(h[3], np.int64) for h in held])
            pieces = -(-counts // MARK)
            size = np.full(int(pieces.sum()), MARK, np.int64)
            last = np.cumsum(pieces)[pieces > 0] - 1
            size[last] = (counts - (pieces - 1) * MARK)[pieces > 0]
            before = np.cumsum([0] + [len(h[5]) for h in held[:-1]]) * 8
            marks = np.concatenate([np.frombuffer(h[4], "<u8").astype(np.int64) + x for h, x in zip(held, before, strict=True)])
            ids = book.decode(b"".join(h[5] for h in held), marks, size).astype("<u4").tobytes()
            ends = np.cumsum(counts)
            out = [ids[4 * (e - n) : 4 * e] for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            starts = np.concatenate([np.cumsum(h[3]) - h[3] + h[1] + base[h[0]] for h in held])
            keys = [x for h in held for x in h[2]]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts), pa.array(out, pa.binary())], schema=schema)

        held, size = [], 0  # a few blocks at a time advance together
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += sum(row[3])
                if size >= 1 << 21:
                    yield decoded(held)
                    held, size = [], 0
        if held:
            yield decoded(held)

    return blocks.select("shard", "first", "doc_ids", "counts", "marks", "payload").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")
