"""Substring dedup: repeated word windows, found by Rabin-Karp hashes counted in Spark.

Every window of ``width`` consecutive words gets two independent rolling hashes from prefix sums over
word hashes: one chooses a hash range, the other, of 64 bits, is what the range sees.  Texts are dealt
into chunks of a few megabytes by a hash of their row; a chunk sends the sorted distinct hashes of its
windows as one binary value a range, and the range answers with one bit a hash: does another chunk
have it?  So the corpus is counted with eight bytes a window in the shuffle and one bit on the way
back, and the same chunk, read again from the same shuffle, marks the covered words.  Windows that
repeat merge into maximal intervals.  A chunk sends each hash once, so copies do not load a range.

Two different windows are taken for equal if both hashes agree, the first in as many bits as it takes
to tell the ranges apart.  As ranges have a fixed size, false pairs are expected in proportion to the
windows, one in 2**44 of them (about 100 TB of text), and each would remove one window that does not
repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.llm.workspace import shuffle_width
from tessera.workers import lean_cogroup, lean_group

#: Least sizes of a chunk and of a range; beyond a few terabytes both grow with the root of the input,
#: so that a chunk still has ``FILL`` windows for a range and rows do not become single hashes.
CHUNK_BYTES, RANGE_WINDOWS, FILL = 4 << 20, 1 << 21, 16
_OUT = "row {row}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def _windows(column: pa.ChunkedArray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the texts: the range, the hash, the word position (over all texts) where each
    starts; and the word offsets by text."""
    data, offsets = arrays.text_buffers(column)
    ranges, hashes, places, words, upto = [], [], [], [np.zeros(1, np.int64)], 0
    for a, b in arrays.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, by_text = arrays.word_spans(part, offsets[a : b + 1] - offsets[a])
        at, _ = arrays.inside_texts(by_text, width)
        if len(at):
            own = arrays.word_hashes(part, starts, ends)
            hashes.append(arrays.window_hashes(own, width)[at])
            ranges.append((arrays.window_hashes(own, width, second=True)[at] >> np.uint64(64 - bits)).astype(np.uint32))
            places.append(at + upto)
        words.append(by_text[1:] + upto)
        upto += len(starts)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none.astype(np.uint32), *ranges]), np.concatenate([none, *hashes]), np.concatenate([none.astype(np.int64), *places]), np.concatenate(words)


def _distinct(ranges: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, present, borders): windows by range and hash, where in this order each distinct one
    begins, the ranges that occur, and where each of these begins among the distinct ones, with the end."""
    key = ranges.astype(np.uint64) << np.uint64(64 - bits) | hashes >> np.uint64(bits)
    order = np.argsort(key, kind="stable")
    key, own = key[order], hashes[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    in_range = key[first] >> np.uint64(64 - bits)
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(first)), bool), in_range[1:] != in_range[:-1]]))
    return order, first, in_range[begins].astype(np.int64), np.append(begins, len(first))


def remove_repeats(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text", layout: bool = False) -> DataFrame:
    """Remove each word that lies in a window of ``width`` words which also starts anywhere else.

    Returns (row, n_words, n_removed, spans, kept): ``row`` is a struct of the input's columns
    (whatever their names) without the text, ``spans`` the removed word intervals, ``kept`` the
    other words joined by one blank; with ``layout`` a text that loses nothing stays as it is.
    A null or empty text has no words and keeps '' (with ``layout`` itself).  A text of
    fewer than ``width`` words loses nothing.  Repeated rows count as places of their own, null
    keys too; an empty table stays empty.  Rows are dealt by key, text and the input's partition,
    so rows without a key or repeated ones do not meet in one chunk.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    windows = size / 6  # a word with its blank has about six bytes
    root = (FILL * windows) ** 0.5
    chunks = max(shuffle_width(spark), int(-(-size // max(CHUNK_BYTES, 6 * root))))
    bits = max(1, int(np.ceil(np.log2(max(shuffle_width(spark), windows / max(RANGE_WINDOWS, root))))))
    rest = [c for c in docs.columns if c != text]
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(key), F.col(text), F.spark_partition_id()), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(text).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
    )

    def send(table: pa.Table) -> pa.Table:
        ranges, hashes, _, _ = _windows(table["text"], width, bits)
        order, first, present, edges = _distinct(ranges, hashes, bits)
        found = hashes[order[first]].astype("<u8")
        blobs = [found[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        chunk = table["chunk"][0].as_py()
        return pa.table({"range": pa.array(present, pa.int32()), "chunk": pa.array([chunk] * len(present), pa.int32()), "hashes": pa.array(blobs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        data, offsets = arrays.text_buffers(table["hashes"])
        found = data.view("<u8")
        by = np.argsort(found, kind="stable")
        ordered = found[by]
        same = ordered[1:] == ordered[:-1]
        flag = np.zeros(len(found), bool)
        flag[by[1:][same]] = True
        flag[by[:-1][same]] = True
        flags = [np.packbits(flag[a:b]).tobytes() for a, b in zip((offsets[:-1] // 8).tolist(), (offsets[1:] // 8).tolist(), strict=True)]
        return pa.table({"chunk": table["chunk"], "range": table["range"], "flags": pa.array(flags, pa.binary())})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        ranges, hashes, places, words = _windows(left["text"], width, bits)
        order, first, present, edges = _distinct(ranges, hashes, bits)
        times = np.diff(np.append(first, len(order)))
        again = times > 1
        at = np.searchsorted(present, right["range"].to_numpy().astype(np.int64))
        for i, flags in zip(at.tolist(), right["flags"], strict=True):
            a, b = edges[i], edges[i + 1]
            again[a:b] |= np.unpackbits(np.frombuffer(flags.as_buffer(), np.uint8))[: b - a].astype(bool)
        edge = np.zeros(int(words[-1]) + width + 1, np.int32)
        hit = places[order[np.repeat(again, times)]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        covered = np.cumsum(edge)[: int(words[-1])] > 0
        texts = left["text"].to_pylist()
        removed, spans, kept = [], [], []
        for i, t in enumerate(texts):
            own = covered[words[i] : words[i + 1]]
            n_own = int(own.sum())
            parts = (t or "").encode().split()  # splits at exactly the six ASCII spaces
            removed.append(n_own)
            if n_own:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                parts = [p for p, gone in zip(parts, own, strict=True) if not gone]
            else:
                spans.append([])
            kept.append(t if layout and not n_own else b" ".join(parts).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"row": left["row"].cast(arrays.nullable(left["row"].type)), "n_words": pa.array(np.diff(words), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.string())})

    groups = dealt.groupBy("chunk")
    sent = groups.applyInArrow(lean_group(send, "substrings"), "`range` int, chunk int, hashes binary")
    flags = sent.groupBy("range").applyInArrow(lean_group(count), "chunk int, `range` int, flags binary")
    schema = _OUT.format(row=dealt.schema["row"].dataType.simpleString())
    return groups.cogroup(flags.groupBy("chunk")).applyInArrow(lean_cogroup(mark), schema)


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), again AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN again USING (win), (SELECT unnest(range(0, 35)) AS k)
), words AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d
), kept AS (
  SELECT w.doc_id, count(c.j) AS n_removed, string_agg(x, ' ' ORDER BY w.j) FILTER (WHERE c.j IS NULL) AS kept
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.j = c.j GROUP BY w.doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
