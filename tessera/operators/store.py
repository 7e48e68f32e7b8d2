"""A versioned chunk table on Parquet, merged on read: upsert, delete, backfill, heal, meta values.

The table is cut into buckets by a hash of the key.  A bucket is a base folder and the folders of later
changes, its layers; a change writes one layer for the buckets that it touches, with the changed rows and
marks for the keys that went, and never rewrites the rows that stay.  Readers take the last layer's
row of a key.  A bucket of too many or too large layers is written anew as one base in the same change.

Numbered pointer files tell the layers of each bucket; the pointer with the next number is created and never
overwritten, and readers take the highest whole one: they see the old or the new state and never a part.
Of two writers at once, the second puts its layers behind the first one's if they touch different buckets,
and fails if not.  What the pointer before the current one names stays for readers that are still at it,
and what no pointer has named yet stays for its writer.  A pointer also tells the last batch of each named
stream that is in the table, so that a batch that is played again changes nothing.  Nothing is collected
but pointers and the numbers of touched buckets.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = (
    "chunk_key string, url string, anchor string, page_title string, heading_path string, library string, kind string, "
    "source_link string, content_hash string, index_version string, part int, embedding array<float>, lexemes array<string>, content string, ordinal int"
)
COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
META = "key string, value string"
_FIXED_BY_KEY = ("url", "anchor")
#: Columns that came later, with what they hold in older versions.
DEFAULTS = {"part": "0", "content": "''", "lexemes": "array()", "ordinal": "0"}
_END = "end"
_OTHER_WIDTH = "an embedding has another width than"
#: A bucket of more layers becomes one base, and one whose layers have so many bytes and more than this share of its base's.
MOST_LAYERS = 8
LAYER_BYTES = 16 << 20
LAYER_SHARE = 0.5
#: A folder that no pointer has ever named belongs to a writer at work until it is so old.
LEASE_SECONDS = 24 * 3600.0
#: How long a pointer that is not whole is taken for one that is being written.
WRITING_SECONDS = 2.0


def merged(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = _FIXED_BY_KEY) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key (but for ``keep``); others stay or come in."""
    pick = [F.col(f"o.{c}") if c == "chunk_key" else (F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(F.col("n.chunk_key").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))) for c in COLUMNS]
    both = old.alias("o").join(new.alias("n"), F.col("o.chunk_key") == F.col("n.chunk_key"), "full_outer")
    pick[0] = F.coalesce("o.chunk_key", "n.chunk_key")
    return both.select(*[p.alias(c) for p, c in zip(pick, COLUMNS, strict=True)])


def kept_columns(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` with what ``merged`` would keep of ``old``; of ``old`` only these columns are read."""
    stored = old.select("chunk_key", *[F.col(c).alias(f"_{c}") for c in _FIXED_BY_KEY])
    both = new.join(stored, "chunk_key", "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in _FIXED_BY_KEY else F.col(c) for c in COLUMNS])


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last in ``order``."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def todo(units: DataFrame, known: DataFrame) -> DataFrame:
    """Units whose page hash is unknown or differs from the stored one."""
    old = known.select("chunk_key", F.col("content_hash").alias("_old"))
    return units.join(old, "chunk_key", "left").where(~F.col("_old").eqNullSafe(F.col("content_hash"))).drop("_old")


def drifted(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live units whose key is stored with another content; units on one side only are left alone."""
    old = stored.select("chunk_key", F.col("content").alias("_old"))
    return live.join(old, "chunk_key").where(F.col("_old") != F.col("content")).drop("_old")


def healed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Content, hash, embedding and lexemes together from ``fresh``, for stored keys only."""
    parts = ("content", "content_hash", "embedding", "lexemes")
    new = fresh.select("chunk_key", F.struct(*parts).alias("_new"))
    both = stored.join(new, "chunk_key", "left")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in parts else F.col(c) for c in COLUMNS])


def backfilled(stored: DataFrame, units: DataFrame) -> DataFrame:
    """Empty contents filled where a non-empty one is known."""
    new = units.where("content <> ''").select("chunk_key", F.col("content").alias("_new")).dropDuplicates(["chunk_key"])
    both = stored.join(new, "chunk_key", "left")
    return both.withColumn("content", F.when(F.col("content") == "", F.coalesce("_new", F.lit(""))).otherwise(F.col("content"))).select(*COLUMNS)


def purged(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Without the keys that no live unit has."""
    return stored.join(live.select("chunk_key"), "chunk_key", "left_semi")


class Conflict(RuntimeError):
    """Another writer has changed the same buckets meanwhile."""


class Pointer(NamedTuple):
    number: int
    layers: dict[int, tuple[str, ...]]
    batches: dict[str, int]


_shared: dict[tuple[str, str], IndexStore] = {}
_lock = threading.Lock()


def shared_store(spark: SparkSession, path: str, width: int | None = None) -> IndexStore:
    """One handle an application and folder, for all threads; it is probed when it is made."""
    key = (spark.sparkContext.applicationId, path.rstrip("/"))
    if key not in _shared:
        with _lock:
            if key not in _shared:
                made = IndexStore(spark, path, width)
                if not made.probe():
                    raise OSError(f"{path} cannot be written and read")
                _shared[key] = made
    return _shared[key]


class IndexStore:
    """Chunks and meta values below one folder; ``buckets`` counts for a new store, an old one keeps its own.

    ``width`` is the length of vectors: where the stored ones have another the table reads as empty, and the
    next build makes it anew.
    """

    def __init__(self, spark: SparkSession, path: str, width: int | None = None, buckets: int = 16):
        self.spark, self.path, self.width, self.buckets = spark, path.rstrip("/"), width, buckets
        #: Buckets that got a layer by the last change of this handle.
        self.written = 0

    # files

    def _fs(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, start: str) -> list[str]:
        fs, place = self._fs("")
        if not fs.exists(place):
            return []
        return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(place)) if n.startswith(start))

    def _read(self, name: str) -> list[str]:
        fs, place = self._fs(name)
        stream = fs.open(place)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def _pointers(self, table: str) -> list[Pointer]:
        """The whole pointers, the newest first."""
        out = []
        for name in reversed(self._names(f"_{table}_now_")):
            lines = self._read(name)
            if lines[-1] == _END:  # else its writer did not come to the end
                cells = [x.split(" ") for x in lines[1:-1]]
                layers = {int(c[0]): tuple(c[1:]) for c in cells if c[0] != "batch"}
                out.append(Pointer(int(name.rsplit("_", 1)[1]), layers, {" ".join(c[2:]): int(c[1]) for c in cells if c[0] == "batch"}))
                if table == "chunks":
                    self.buckets = int(lines[0])
        return out

    def _newest(self, table: str) -> int:
        """The highest number in use, also by a pointer that is not whole."""
        return max((int(n.rsplit("_", 1)[1]) for n in self._names(f"_{table}_now_")), default=0)

    def _current(self, table: str) -> Pointer:
        """The newest state and the highest number in use; waits a little for a pointer that is being written."""
        until = time.monotonic() + WRITING_SECONDS
        while True:
            highest, whole = self._newest(table), self._pointers(table)
            if not highest or whole and whole[0].number == highest or time.monotonic() >= until:
                return whole[0]._replace(number=highest) if whole else Pointer(highest, {}, {})
            time.sleep(0.1)

    def _commit(self, table: str, after: int, layers: dict[int, tuple[str, ...]], batches: dict[str, int] | None = None) -> None:
        """Create the pointer that follows number ``after``; fails if there is one, or a later one (that one may be swept)."""
        fs, place = self._fs(f"_{table}_now_{after + 1:012d}")
        changed = Conflict(f"{self.path}: {table} has changed since number {after}")
        if self._newest(table) != after:
            raise changed
        try:
            stream = fs.create(place, False)
        except Exception as e:
            raise changed from e
        marks = [f"batch {n} {label}" for label, n in sorted((batches or {}).items())]
        stream.write(bytearray("\n".join([str(self.buckets), *(f"{b} {' '.join(fs)}" for b, fs in sorted(layers.items())), *marks, _END]).encode()))
        stream.close()
        self._sweep(table)

    def _drop(self, name: str) -> None:
        fs, place = self._fs(name)
        fs.delete(place, True)

    def _sweep(self, table: str) -> None:
        """Delete what only pointers before the previous one name, those pointers, and what was never named and is old."""
        whole = self._pointers(table)
        kept = {f for p in whole[:2] for fs in p.layers.values() for f in fs}
        alive = {f.split("/")[0] for f in kept}
        named = {f for p in whole for fs in p.layers.values() for f in fs}
        for f in named - kept:
            self._drop(f)
        for name in self._names(f"{table}-"):
            if name not in alive and (name in {f.split("/")[0] for f in named} or self._age(name) > LEASE_SECONDS):
                self._drop(name)
        for name in self._names(f"_{table}_now_"):
            if len(whole) > 1 and int(name.rsplit("_", 1)[1]) < whole[1].number:
                self._drop(name)

    def _age(self, name: str) -> float:
        fs, place = self._fs(name)
        return time.time() - fs.getFileStatus(place).getModificationTime() / 1000

    def _bytes(self, name: str) -> int:
        fs, place = self._fs(name)
        return fs.getContentSummary(place).getLength()

    # chunks

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("chunk_key"), F.lit(self.buckets)).cast("int")

    def _filled(self, rows: DataFrame) -> DataFrame:
        """All columns, with the defaults of those that are missing or null."""
        kinds = {c.split()[0]: c.split()[1] for c in CHUNKS.split(", ")}
        own = lambda c: F.expr(f"try_cast({c} AS {kinds[c]})") if c in rows.columns and dict(rows.dtypes)[c] == "string" and kinds[c] != "string" else F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c])
        return rows.select(*[F.coalesce(own(c), F.expr(DEFAULTS[c]).cast(kinds[c])).alias(c) if c in DEFAULTS else F.col(c) for c in COLUMNS], *[c for c in rows.columns if c == "_gone"])

    def _chunks(self, folders: list[str]) -> DataFrame:
        """The rows of folders, with the marks of those that went."""
        if not folders:
            return self.spark.createDataFrame([], CHUNKS + ", _gone boolean")
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in folders])
        gone = F.coalesce(F.col("_gone"), F.lit(False)) if "_gone" in rows.columns else F.lit(False)
        return self._filled(rows.withColumn("_gone", gone))

    def _state(self, layers: dict[int, tuple[str, ...]]) -> DataFrame:
        """The rows of buckets: of one layer as they are, of several the last row of each key."""
        stays = lambda df: df.where("not _gone").drop("_gone")
        single = stays(self._chunks(sorted(fs[0] for fs in layers.values() if len(fs) == 1)))
        several = [fs for fs in layers.values() if len(fs) > 1]
        if not several:
            return single
        later = None
        for k in range(1, max(map(len, several))):
            level = self._chunks(sorted(fs[k] for fs in several if len(fs) > k)).withColumn("_layer", F.lit(k))
            later = level if later is None else later.unionByName(level)
        last = later.groupBy("chunk_key").agg(F.max_by(F.struct(*[c for c in COLUMNS if c != "chunk_key"], "_gone"), "_layer").alias("_r"))
        last = last.select("chunk_key", *[f"_r.{c}" for c in (*COLUMNS[1:], "_gone")])
        base = stays(self._chunks(sorted(fs[0] for fs in several))).join(last.select("chunk_key"), "chunk_key", "left_anti")
        return single.unionByName(base.select(*COLUMNS)).unionByName(stays(last))

    def chunks(self) -> DataFrame:
        """The current state with defaults for later columns; empty where there is none, or where the
        stored vectors have another width."""
        now = self._pointers("chunks")
        rows = self._state(now[0].layers if now else {})
        if self.width is not None and rows.where(F.size("embedding") != self.width).limit(1).count():
            return self.spark.createDataFrame([], CHUNKS)
        return rows

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows whose write fails with a ``ValueError`` if a vector has another width; nothing is read twice for it."""
        rows = self._filled(rows)
        if self.width is None:
            return rows
        right = F.col("embedding").isNotNull() & (F.size("embedding") == self.width)
        wrong = F.raise_error(F.lit(f"{_OTHER_WIDTH} {self.width}")).cast("array<float>")
        return rows.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(wrong))

    def _write(self, rows: DataFrame) -> dict[int, tuple[str, ...]]:
        """New folders of the buckets that have rows."""
        folder = f"chunks-{uuid.uuid4().hex}"
        try:
            rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        except Exception as e:
            if _OTHER_WIDTH in str(e):
                raise ValueError(f"{_OTHER_WIDTH} {self.width}") from e
            raise
        fs, place = self._fs(folder)
        names = [x.getPath().getName() for x in fs.listStatus(place)]
        return {int(n.removeprefix("bucket=")): (f"{folder}/{n}",) for n in names if n.startswith("bucket=")}

    def replace(self, rows: DataFrame) -> None:
        """All chunks anew."""
        now = self._current("chunks")
        self._commit("chunks", now.number, self._write(self._checked(rows)), now.batches)

    def change(self, keys: DataFrame, to, batch: tuple[str, int] | None = None) -> int:
        """``to(old)`` takes the place of the stored rows ``old`` of ``keys``; what it leaves out goes, all other rows
        stay where they are.  Returns how many buckets got a layer.

        A ``batch`` (name of a stream, number) that the table has already changes nothing.
        """
        began = self._current("chunks")
        if batch and began.batches.get(batch[0], -1) >= batch[1]:
            return 0
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # at most one row a bucket
        if not touched:
            return 0
        wanted = keys.select("chunk_key").distinct()
        old = self._state({b: began.layers[b] for b in touched if b in began.layers})
        fresh = self._checked(to(old.join(wanted, "chunk_key", "left_semi").select(*COLUMNS)))
        rows = wanted.join(fresh.withColumn("_here", F.lit(True)), "chunk_key", "left").withColumn("_gone", F.col("_here").isNull()).drop("_here")
        made = self._write(rows)
        layers = {b: began.layers.get(b, ()) + fs for b, fs in made.items()}
        layers |= self._write_anew({b: fs for b, fs in layers.items() if self._heavy(fs)})
        self._rebase(began, layers, batch)
        self.written = len(made)
        return self.written

    def _heavy(self, layers: tuple[str, ...]) -> bool:
        if len(layers) < 2 or len(layers) > MOST_LAYERS:
            return len(layers) > 1
        later = sum(self._bytes(f) for f in layers[1:])
        return later >= LAYER_BYTES and later > LAYER_SHARE * self._bytes(layers[0])

    def _write_anew(self, layers: dict[int, tuple[str, ...]]) -> dict[int, tuple[str, ...]]:
        """One base for each bucket; a bucket without rows has no folder."""
        return dict.fromkeys(layers, ()) | (self._write(self._state(layers)) if layers else {})

    def compact(self) -> int:
        """Every bucket of several layers becomes one base; returns how many."""
        began = self._current("chunks")
        several = {b: fs for b, fs in began.layers.items() if len(fs) > 1}
        if several:
            self._rebase(began, self._write_anew(several), None)
        return len(several)

    def _rebase(self, began: Pointer, layers: dict[int, tuple[str, ...]], batch: tuple[str, int] | None) -> None:
        """Commit new layers of buckets on the state that ``began`` had, or on a newer one that has the same of them."""
        now = began
        while True:
            merged_layers = {b: fs for b, fs in (now.layers | layers).items() if fs}
            try:
                return self._commit("chunks", now.number, merged_layers, now.batches | ({batch[0]: batch[1]} if batch else {}))
            except Conflict:
                now = self._current("chunks")
                moved = any(now.layers.get(b) != began.layers.get(b) for b in layers)
                if moved or batch and now.batches.get(batch[0], -1) >= batch[1]:
                    raise

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        rows = self._filled(rows)
        return self.change(rows, lambda old: merged(old, rows), batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        return self.change(keys, lambda old: old.where("false"), batch)

    def heal(self, fresh: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Content, hash, vector and lexemes of stored chunks together; keys that are not stored stay out."""
        return self.change(fresh, lambda old: healed(old, fresh), batch)

    # rows of a build that is not finished

    def stage(self, stamp: str, rows: DataFrame) -> None:
        """Keep finished rows of a build (or some of their columns) for a later try of the same recipe; they are not in the table yet."""
        missing = [c.split() for c in CHUNKS.split(", ") if c.split()[0] not in rows.columns]
        rows = rows.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in missing])
        self._filled(rows).write.parquet(f"{self.path}/_staged-{_digest(stamp)}-{uuid.uuid4().hex}")

    def staged(self, stamp: str) -> DataFrame:
        """What tries of this recipe have finished, one row a key and hash."""
        done = []
        for name in self._names(f"_staged-{_digest(stamp)}-"):
            fs, mark = self._fs(f"{name}/_SUCCESS")
            if fs.exists(mark):
                done.append(name)
        return self._chunks(done).drop("_gone").dropDuplicates(["chunk_key", "content_hash"])

    def unstage(self, stamp: str) -> None:
        """Delete the staged rows of this recipe, and those of others that are older than a lease."""
        for name in self._names("_staged-"):
            if name.startswith(f"_staged-{_digest(stamp)}-") or self._age(name) > LEASE_SECONDS:
                self._drop(name)

    # meta values

    def meta(self) -> DataFrame:
        now = self._pointers("meta")
        return self.spark.read.schema(META).parquet(f"{self.path}/{now[0].layers[0][0]}") if now else self.spark.createDataFrame([], META)

    def get_meta(self, key: str) -> str | None:
        row = self.meta().where(F.col("key") == key).first()
        return row.value if row else None

    def set_meta(self, key: str, value: str) -> None:
        after = self._current("meta").number
        folder = f"meta-{uuid.uuid4().hex}"
        rest = self.meta().where(F.col("key") != key)
        rest.unionByName(self.spark.createDataFrame([(key, value)], META)).coalesce(1).write.parquet(f"{self.path}/{folder}")
        self._commit("meta", after, {0: (folder,)})

    def probe(self) -> bool:
        """Write, read and drop a scratch table."""
        place = f"{self.path}/_probe-{uuid.uuid4().hex}"
        self.spark.range(1).write.parquet(place)
        found = self.spark.read.parquet(place).count() == 1
        fs, p = self._fs(place.rsplit("/", 1)[1])
        fs.delete(p, True)
        return found


def _digest(stamp: str) -> str:
    return hashlib.sha256(stamp.encode()).hexdigest()[:16]


def saved_pages(stored: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot after the crawl, changed pages per library): pages with an equal hash are not written anew."""
    old = stored.select("url", F.col("content_hash").alias("_old"))
    marked = fresh.join(old, "url", "left").withColumn("changed", ~F.col("_old").eqNullSafe(F.col("content_hash")))
    changed = marked.where("changed").drop("_old", "changed")
    kept = stored.join(changed.select("url"), "url", "left_anti")
    counts = marked.groupBy("library").agg(F.count_if("changed").alias("n_changed"))
    return kept.unionByName(changed), counts
