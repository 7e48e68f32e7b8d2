"""Incremental index build and the freshness pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.config import Config
from tessera.functions.text import chunk_key, indexed_text
from tessera.operators import store as ops
from tessera.operators.store import IndexStore

#: Batches of a build, at most: each is a job of its own, and their number must not grow with the input.
MOST_BATCHES = 16
#: Turns (chunk_key, text) into (chunk_key, embedding); a model loads once a worker in its UDF.
Embed = Callable[[DataFrame], DataFrame]


class BatchModel:
    """A model that is called with arrays of texts where the rows are, so no join brings its vectors back.

    ``load`` runs once a Python worker and returns what turns an array of texts into as many vectors
    (a matrix of floats); ``batch`` is the most texts in one call.
    """

    def __init__(self, load: Callable[[], Callable], batch: int = Config.batch_rows):
        self.vector = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch)

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.select("chunk_key", self.vector(F.col("text")).alias("embedding"))


class Scratch:
    """Tables of one build below the store's folder, deleted at its end."""

    def __init__(self, store: IndexStore):
        self.store, self.name = store, f"_work-{uuid.uuid4().hex}"

    def save(self, rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
        where, schema = f"{self.store.path}/{self.name}/{name}", rows.schema
        (rows.write.partitionBy(by) if by else rows.write).parquet(where)
        return rows.sparkSession.read.schema(schema).parquet(where)

    def drop(self) -> None:
        self.store._drop(self.name)


def recipe(shape: str, model: str, glosses: str, questions: str) -> str:
    """Stamp of how rows were made; another one makes all rows anew."""
    return f"{shape}-{model.rsplit('/', 1)[-1]}-g{glosses}-q{questions}"


def enrichment_stamp(rows: DataFrame | None) -> str:
    """Eight hex digits of an enrichment table's content, whatever its order; ``none`` without one."""
    if rows is None:
        return "none"
    n = rows.select(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).alias("s")).first().s
    return f"{int(n or 0) & 0xFFFFFFFF:08x}"


def units_with_text(units: DataFrame, glosses: DataFrame | None, questions: DataFrame | None) -> DataFrame:
    """Units with ``chunk_key`` and the text that is embedded and searched."""
    spark = units.sparkSession
    glosses = glosses if glosses is not None else spark.createDataFrame([], "url string, gloss string")
    questions = questions if questions is not None else spark.createDataFrame([], "url string, questions array<string>")
    rows = units.join(glosses.select("url", "gloss"), "url", "left").join(questions.select("url", "questions"), "url", "left")
    key = chunk_key(F.col("url"), F.col("anchor"), F.col("heading_path"), F.col("part"))
    text = indexed_text(F.col("url"), F.col("synopsis"), F.col("gloss"), F.col("questions"), F.col("heading_path"), F.col("content"))
    return rows.withColumns({"chunk_key": key, "text": text}).drop("gloss", "questions")


def index_rows(units: DataFrame, embed: Embed, lexemes: Callable, version: str, limit: int = Config.embed_chars) -> DataFrame:
    """Rows of the chunk table from units with text; the model sees the first ``limit`` characters."""
    seen = F.left("text", F.lit(limit))
    found = units.withColumn("embedding", embed.vector(seen)) if isinstance(embed, BatchModel) else units.join(embed(units.select("chunk_key", seen.alias("text"))), "chunk_key")
    return shaped(found, lexemes, version)


def shaped(found: DataFrame, lexemes: Callable, version: str) -> DataFrame:
    """Rows of the chunk table from units with text and vector."""
    rows = found.withColumns({"lexemes": lexemes(F.col("text")), "heading_path": F.array_join("heading_path", " > "), "index_version": F.lit(version)})
    return rows.select(*ops.COLUMNS)


def build_index(store: IndexStore, units: DataFrame, embed: Embed, lexemes: Callable, version: str, stamp: str = "", glosses: DataFrame | None = None, questions: DataFrame | None = None, batch_rows: int = 1 << 20) -> dict[str, int]:
    """Embed what is new or changed, fill empty contents, purge what is gone; the stamp is written last.

    An empty snapshot is refused.  Of units with equal keys the later one counts, but both are counted
    as read.  With another stamp every row is made anew; purging compares with what was stored.  Keys and
    hashes tell what is to do: the keys of it are written once, and texts are read for them only.  Work is
    done in batches of about ``batch_rows`` units, or ``MOST_BATCHES`` larger ones, each of which reads its own part (what
    the model sees) and whose vectors are kept when it is done, so that a build that was cut off goes on behind them.
    Whole texts are shuffled once, to the rows that are written.  The table is changed where
    keys change: buckets without one keep their files, and without any nothing is written (``store.written`` counts buckets).
    """
    space, store.written = Scratch(store), 0
    try:
        return _build(store, space, units, embed, lexemes, version, stamp, glosses, questions, batch_rows)
    finally:
        space.drop()


def _build(store: IndexStore, space: Scratch, units: DataFrame, embed: Embed, lexemes: Callable, version: str, stamp: str, glosses: DataFrame | None, questions: DataFrame | None, batch_rows: int) -> dict[str, int]:
    key = chunk_key(F.col("url"), F.col("anchor"), F.col("heading_path"), F.col("part"))
    at = F.struct("url", "ordinal")
    stored = store.chunks()
    stamps = {r.key: r.value for r in store.meta().collect()}
    again = stamps.get("recipe") != stamp
    recipe = f"{version} {stamp}"
    # one row a key of either side: what is live, what is stored, and what differs
    live = units.select(key.alias("chunk_key"), at.alias("at"), "content_hash", (F.col("content") != "").alias("full")).groupBy("chunk_key")
    live = live.agg(F.count("*").alias("n"), F.max_by(F.struct("at", "content_hash", "full"), "at").alias("u"))
    known = stored.select("chunk_key", F.col("content_hash").alias("_old"), (F.col("content") == "").alias("_empty"), F.lit(True).alias("_there"))
    both = live.join(known, "chunk_key", "full_outer").select("chunk_key", F.coalesce("n", F.lit(0)).alias("n"), "u.at", "u.content_hash", F.coalesce("_there", F.lit(False)).alias("there"), F.coalesce(F.col("u.full") & F.col("_empty"), F.lit(False)).alias("fill"), (~F.col("_old").eqNullSafe(F.col("u.content_hash")) | F.lit(again)).alias("new"))
    is_live, new = F.col("n") > 0, (F.col("n") > 0) & F.col("new")
    marks = space.save(both.withColumns({"gone": ~is_live, "new": new}), "marks")
    counts = marks.agg(F.sum("n").alias("units"), F.count_if(F.col("n") > 0).alias("live"), F.count_if("new").alias("new"), F.count_if("gone").alias("gone"), F.count_if(F.col("fill") & ~F.col("new")).alias("fill")).first()
    if not counts.units:
        raise ValueError("the snapshot has no chunks; the index stays as it is")
    stats = {"snapshot_chunks": counts.units, "embedded": 0, "purged": counts.gone, "total": counts.live}
    if counts.new or counts.gone or counts.fill:
        wanted = marks.where("new").select("chunk_key", "at", "content_hash")
        known = store.staged(recipe).select("chunk_key", "content_hash")
        rest = wanted.join(known, ["chunk_key", "content_hash"], "left_anti").select("chunk_key", "at")
        once = counts.units == counts.live  # no key twice
        parts = min(MOST_BATCHES, max(1, -(-counts.new // batch_rows)))
        stats["embedded"] = rest.count() if counts.new else 0
        if stats["embedded"]:
            # what the model sees begins with the first characters of the content
            seen = units.withColumn("content", F.left("content", F.lit(Config.embed_chars)))
            work = _marked(seen, rest, glosses, questions, once).select("chunk_key", "content_hash", F.left("text", F.lit(Config.embed_chars)).alias("text"))
            work = space.save(work.withColumn("batch", F.pmod(F.xxhash64("chunk_key", F.lit(1)), F.lit(parts)).cast("int")), "work", "batch")
            for i in range(parts):
                store.stage(recipe, _vectors(work.where(F.col("batch") == i).drop("batch"), embed))
        vectors = store.staged(recipe).select("chunk_key", "content_hash", "embedding")
        new = wanted.join(vectors, ["chunk_key", "content_hash"]).drop("content_hash")
        fill = marks.where("fill and not new").select("chunk_key", "at")

        def to(old: DataFrame) -> DataFrame:
            rows = shaped(_marked(units, new, glosses, questions, once), lexemes, version)
            rows = ops.kept_columns(rows, old)
            # contents of units whose stored one is empty
            return rows.unionByName(ops.backfilled(old.join(fill.select("chunk_key"), "chunk_key", "left_semi"), _marked(units, fill, None, None, once))) if counts.fill else rows

        store.change(marks.where("new or gone or fill"), to)
        store.unstage(recipe)
    for name, value in (("recipe", stamp), ("index_version", version)):
        if stamps.get(name) != value:
            store.set_meta(name, value)
    return stats


def _vectors(work: DataFrame, embed: Embed) -> DataFrame:
    """(chunk_key, content_hash, embedding) of texts as the model sees them."""
    if isinstance(embed, BatchModel):
        return work.select("chunk_key", "content_hash", embed.vector(F.col("text")).alias("embedding"))
    return work.select("chunk_key", "content_hash").join(embed(work.select("chunk_key", "text")), "chunk_key")


def _marked(units: DataFrame, marks: DataFrame, glosses: DataFrame | None, questions: DataFrame | None, once: bool) -> DataFrame:
    """The units of ``marks`` (chunk_key, at and more columns), one a key, with these columns and their text.

    What is joined by page is joined to the marks, which are narrow; units meet them by key, and text is made behind that.
    """
    for rows, name in ((glosses, "gloss"), (questions, "questions")):
        if rows is not None:
            marks = marks.join(rows.select(F.col("url").alias("_url"), name), F.col("at.url") == F.col("_url"), "left").drop("_url")
        else:
            marks = marks.withColumn(name, F.lit(None).cast("string" if name == "gloss" else "array<string>"))
    key = chunk_key(F.col("url"), F.col("anchor"), F.col("heading_path"), F.col("part"))
    keyed = units.withColumns({"chunk_key": key, "_at": F.struct("url", "ordinal")})
    both = keyed.join(marks, "chunk_key").where(F.col("_at").eqNullSafe(F.col("at"))).drop("_at", "at")
    text = indexed_text(F.col("url"), F.col("synopsis"), F.col("gloss"), F.col("questions"), F.col("heading_path"), F.col("content"))
    rows = both if once else last_units(both)
    return rows.withColumn("text", text).drop("gloss", "questions")


def last_units(keyed: DataFrame) -> DataFrame:
    """One unit a key: the last by url and ordinal."""
    return ops.last_wins(keyed.withColumn("at", F.struct("url", "ordinal")), "chunk_key", "at").drop("at")


def refresh(store: IndexStore, live_units: DataFrame, embed: Embed, lexemes: Callable, version: str, batch: tuple[str, int] | None = None) -> int:
    """Heal stored chunks whose live content differs; sections on one side only are left alone.

    Returns how many were healed.  Use it in ``foreachBatch`` behind ``streaming.state.due``, with the stream's
    name and the batch's number as ``batch``: what is played again after a failure then heals once.
    """
    space = Scratch(store)
    try:
        key, at, hashed = chunk_key(F.col("url"), F.col("anchor"), F.col("heading_path"), F.col("part")), F.struct("url", "ordinal"), F.sha2("content", 256)
        live = live_units.select(key.alias("chunk_key"), at.alias("at"), hashed.alias("hash")).groupBy("chunk_key").agg(F.count("*").alias("n"), F.max_by(F.struct("at", "hash"), "at").alias("u"))
        old = store.chunks().select("chunk_key", hashed.alias("_old"))
        marks = space.save(live.join(old, "chunk_key").where("_old != u.hash").select("chunk_key", "u.at", "n"), "marks")
        found = marks.agg(F.count("*").alias("keys"), F.sum("n").alias("units")).first()
        if found.keys:
            changed = space.save(_marked(live_units, marks.drop("n"), None, None, found.keys == found.units), "changed")
            store.heal(space.save(index_rows(changed, embed, lexemes, version), "fresh"), batch)
        return found.keys
    finally:
        space.drop()
