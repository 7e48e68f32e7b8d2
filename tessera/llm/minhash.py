"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch (Dahlgaard, Knudsen and Thorup, 2017).  In round i < t every element of a set is hashed to
one of t bins with a value in [i, i + 1), in round t + j to bin j; a bin keeps the smallest value.
Rounds stop once all bins are full, which is sure after 2t rounds and takes a few for large sets;
a coordinate of two sets is equal with the probability of their Jaccard similarity.

1. One pass over the texts keeps set size, a 128-bit set hash and the band hashes.
2. Documents with equal sets form classes, represented by the smallest id; only representatives
   go on, so copies cost nothing further.
3. In each band bucket all members are candidates of the smallest member (its hub), and every
   candidate pair is verified on full sets.  A hub of very many members is dealt over several tasks.
4. A bucket of three or more whose members still lie in different components has pairs that were
   not looked at: the members outside its largest component are compared with all of it on full
   sets, in cells of bounded numbers and bytes.  So no candidate pair of any bucket is lost, and no
   pairs are emitted but verified links, at most one a member in each cell.
5. Components of all verified links.

With ``bands`` bands of ``rows`` coordinates a pair at the threshold is missed with a probability
below 10**-6; no bucket, partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.llm.components import connected
from tessera.llm.workspace import Workspace
from tessera.workers import lean, lean_group

_U = np.uint64
_FULL = np.iinfo(np.uint64).max
#: Members of a block, elements of all sets of a block, and members that meet their hub in one task.
BLOCK, BLOCK_ITEMS, FAN = 512, 1 << 19, 2048


def bands_for(threshold: float, miss: float = 1e-6, most: int = 28) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands miss a pair at the threshold with at most ``miss``.

    At most ``most`` bands, but as many as it takes where a band is one row.
    """
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))
        if bands <= most or rows == 1:
            return bands, rows
    raise ValueError("no rows")


def shingles(column: pa.Array | pa.ChunkedArray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, hashes, counts): sorted distinct shingle hashes of each text, slice by slice.

    A-Z are lower-cased.  A text of 1 to k - 1 words has one shingle, the whole of it.
    """
    data, offsets = arrays.text_buffers(column)
    for a, b in arrays.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, by_text = arrays.word_spans(part, offsets[a : b + 1] - offsets[a])
        words = arrays.word_hashes(part, starts, ends, lower=True)
        at, counts = arrays.inside_texts(by_text, k)
        found, owner = arrays.window_hashes(words, k)[at], np.repeat(np.arange(b - a), counts)
        n_words = np.diff(by_text)
        for short in range(1, k):
            own = np.flatnonzero(n_words == short)
            if len(own):
                whole = arrays.mix(arrays.window_hashes(words, short)[by_text[own]] + _U(short))
                found, owner = np.concatenate([found, whole]), np.concatenate([owner, own])
        by = np.lexsort((found, owner))
        found, owner = found[by], owner[by]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
        yield a, b, found, np.bincount(owner, minlength=b - a)


def sketch(found: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set; the empty set has only the largest value."""
    out = np.full((len(counts), t), _FULL, np.uint64)
    owner, rows, left = np.repeat(np.arange(len(counts)), counts), np.flatnonzero(counts > 0), found
    for i in range(2 * t):
        if len(rows) == 0:
            break
        x = arrays.mix(left + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((x >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out.reshape(-1), owner * t + place, (x & _U(0xFFFFFFFF)) | _U(i << 32))
        open_ = (out[rows] == _FULL).any(axis=1)
        if not open_.all():
            rows = rows[open_]
            keep = np.zeros(len(counts), bool)
            keep[rows] = True
            on = keep[owner]
            owner, left = owner[on], left[on]
    return out


def band_hashes(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cube = coordinates[:, : bands * rows].reshape(len(coordinates), bands, rows)
    out = np.broadcast_to(arrays.mix(np.arange(1, bands + 1, dtype=np.uint64)), cube.shape[:2]).copy()
    for j in range(rows):
        out = arrays.mix(out * _U(0xD1342543DE82EF95) ^ cube[:, :, j])
    return out


def _profiles(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, lo, hi, b0, b1, ...): set size, set hash (sums of two mixes of the elements), band hashes."""
    names = ["doc_id", "n", "lo", "hi", *(f"b{i}" for i in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, counts in shingles(batch.column(1), k):
                upto = np.concatenate([[0], np.cumsum(counts)])
                lo, hi = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(found ^ _U(s)))]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
                hashes = np.ascontiguousarray(band_hashes(sketch(found, counts, bands * rows), bands, rows).T).view(np.int64)
                sums = [(x[upto[1:]] - x[upto[:-1]]).view(np.int64) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in (counts, *sums, *hashes))], names=names)

    return docs.mapInArrow(lean(run, "near"), ", ".join(f"{c} long" for c in names))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, items): the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, counts in shingles(batch.column(1), k):
                upto = np.concatenate([[0], np.cumsum(counts)])
                items = [found[upto[i] : upto[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(items, pa.binary())], names=["doc_id", "items"])

    return docs.mapInArrow(lean(run), "doc_id long, items binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 |a & b| >= percent |a | b|, for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)) for i in (0, 1))
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            ok = np.array(ok, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return pairs.mapInArrow(lean(run), "a long, b long")


def block_links(asked: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Verified links between ``asked`` and ``members`` (node, root, set) that join different roots, as few
    as join them (a forest).  One inverted index of the members answers every asked set."""
    top = {r: r for _, r, _ in [*asked, *members]}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    out: list[tuple[int, int]] = []
    sizes = np.array([len(s) for _, _, s in members], np.int64)
    items = np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s in members)])
    by = np.argsort(items, kind="stable")
    holders = np.repeat(np.arange(len(members)), sizes)[by]
    keys, first = np.unique(items[by], return_index=True)
    first = np.concatenate([first, [len(items)]])
    for node, root, own in asked:
        at = np.searchsorted(keys, own)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own)] if len(keys) else at[:0]
        if len(at) * 100 < percent * len(own):
            continue  # too few of its items occur at all
        reach = np.concatenate([holders[first[e] : first[e + 1]] for e in at])
        shared = np.bincount(reach, minlength=len(members))
        for j in np.flatnonzero((shared > 0) & (100 * shared >= percent * (sizes + len(own) - shared))):
            x, y = find(root), find(members[j][1])
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((node, members[j][0]))
    return out


def _unresolved(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets whose members (h, rep, n elements) lie in different components (step 4).

    Members of a bucket's largest component need no comparison with each other: the others are asked
    against all, in cells of a block of all members and a block of the others.
    """
    seen = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    by_root = seen.groupBy("h", "root").agg(F.count("*").alias("m"), F.sum("n").alias("items"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sign"))
    mixed = by_root.groupBy("h").agg(F.count("*").alias("roots"), F.sum("m").alias("m"), F.sum("items").alias("items"), F.sum("sign").alias("sign"), F.max(F.struct("m", "items", "root")).alias("most"))
    mixed = mixed.where("roots > 1 and m > 2").groupBy("m", "items", "sign").agg(F.min(F.struct("h", "most")).alias("b"))  # buckets of the same members: once
    cells = lambda m, items: F.greatest(F.ceil(m / BLOCK), F.ceil(items / BLOCK_ITEMS)).cast("int")
    plan = mixed.select("b.h", F.col("b.most.root").alias("largest"), cells(F.col("m"), F.col("items")).alias("g"), cells(F.col("m") - F.col("b.most.m"), F.col("items") - F.col("b.most.items")).alias("g2"))
    dealt = seen.join(plan, "h").withColumns({"i": F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"), "j": F.pmod(F.hash("rep"), F.col("g2")).cast("int"), "other": F.col("root") != F.col("largest")})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = dealt.select("h", "rep", "root", "i", F.explode(upto("g2")).alias("j"), F.lit(False).alias("asked")).unionByName(dealt.where("other").select("h", "rep", "root", F.explode(upto("g")).alias("i"), "j", F.lit(True).alias("asked")))
    full = rows.hint("merge").join(sets, rows.rep == sets.doc_id).select("h", "i", "j", "rep", "root", "asked", "items")

    def run(table: pa.Table) -> pa.Table:
        items = (np.frombuffer(x.as_buffer(), np.uint64) for x in table["items"])
        every = list(zip(*(table[c].to_pylist() for c in ("rep", "root")), items, table["asked"].to_pylist(), strict=True))
        found = block_links([e[:3] for e in every if e[3]], [e[:3] for e in every if not e[3]], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return full.groupBy("h", "i", "j").applyInArrow(lean_group(run), "a long, b long")


def _with_hub(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, rep, x, y) of (hub, rep): both sets, a hub's pairs dealt over as many tasks as they need."""
    fans = stars.groupBy("hub").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    dealt = stars.join(fans, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("fans")).cast("int").alias("fan"))
    hubs = fans.join(sets, fans.hub == sets.doc_id).select("hub", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("items").alias("x"))
    near = dealt.join(sets.select(F.col("doc_id").alias("rep"), F.col("items").alias("y")), "rep")
    return near.join(hubs.hint("merge"), ["hub", "fan"]).select("hub", "rep", "x", "y")


def near_duplicates(docs: DataFrame, space: Workspace, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Links join documents with 100 |A & B| >= percent |A | B| of their k-word shingle sets.  A null
    or empty text has no shingle and no link.  Rows of an id are one document: they are linked whatever
    their texts, and each one's links count.  A row with a null id is linked with
    nothing, has a null component and is kept.  An empty table stays empty.
    """
    bands, rows = bands_for(percent / 100)
    own = [f"b{i}" for i in range(bands)]
    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = space.save(_profiles(picked, k, bands, rows), "profiles")
    sized = seen.where("n > 0 and doc_id is not null")
    # equal sets have equal bands, so any row's will do; the minimum of a number needs no sort
    classes = space.save(sized.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("rep"), *[F.min(b).alias(b) for b in own]), "classes")

    dealt = classes.select(F.explode(F.array(*own)).alias("h"), "rep", "n")
    buckets = dealt.groupBy("h").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    # the planner takes exploded rows for as few as they come from: no side of them is to be broadcast
    members = space.save(dealt.hint("merge").join(buckets.hint("merge"), "h"), "members")
    stars = space.save(members.where("rep <> hub").select("hub", "rep").distinct(), "stars")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = picked.withColumn("t", F.xxhash64("text")).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "t"])
    sets = space.save(_sets(texts.select("doc_id", "text"), k), "sets", "none")
    links = space.save(_verified(_with_hub(stars, sets), percent), "links")
    several = sized.groupBy("doc_id").agg((F.min("lo") != F.max("lo")).alias("more")).where("more").select("doc_id")
    if several.head(1):
        homes = sized.join(several, "doc_id", "left_semi").join(classes.select("lo", "hi", "n", "rep"), ["lo", "hi", "n"])
        links = links.union(space.save(homes.select("doc_id", "rep"), "same"))
    roots = connected(links, space, "first")
    more = space.save(_unresolved(members.where("m > 2").select("h", "rep", "n"), roots, sets, percent), "more")
    if more.head(1):
        roots = connected(links.union(more), space, "second")
    space.drop("members", "stars", "sets", "links", "same", "more")
    homes = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("lo", "hi", "n", F.coalesce("root", "rep").alias("root"))
    out = seen.select("doc_id", "n", "lo", "hi").join(homes, ["lo", "hi", "n"], "left")
    home = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), home.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == home)).alias("kept"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN edges ON r = x
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""
