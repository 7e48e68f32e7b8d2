"""Snapshot pages and enrichment files as DataFrames, and their writers."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

from tessera.functions.text import page_path
from tessera.operators.store import last_wins

_NAMES = ("url", "title", "library", "content_hash", "crawled_at")
_META = StructType()
for _name in _NAMES:
    _META = _META.add(_name, StringType())


@pandas_udf(_META)
def front_matter(head: pd.Series) -> pd.DataFrame:
    rows = [yaml.safe_load(x) or {} if x else {} for x in head]
    return pd.DataFrame([[None if r.get(n) is None else str(r[n]) for n in _NAMES] for r in rows], columns=list(_NAMES))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files (front matter between two ``---`` lines, then the body) below ``path``, one row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    text = F.decode("content", "UTF-8")
    cut = F.split(text, "---\n", 3)
    parts = files.select("path", front_matter(F.get(cut, 1)).alias("m"), F.regexp_replace(F.get(cut, 2), "^\n+", "").alias("body"))
    return parts.select("m.*", "body", "path")


@pandas_udf(StringType())
def page_file(url: pd.Series, title: pd.Series, library: pd.Series, content_hash: pd.Series, crawled_at: pd.Series, body: pd.Series) -> pd.Series:
    rows = zip(url, title, library, content_hash, crawled_at, strict=True)
    return pd.Series([f"---\n{yaml.safe_dump(dict(zip(_NAMES, r, strict=True)), sort_keys=True)}---\n\n{b}\n" for r, b in zip(rows, body, strict=True)], dtype=object)


def page_files(pages: DataFrame) -> DataFrame:
    """(path, text) of each page as a snapshot file."""
    return pages.select(page_path(F.col("url")).alias("path"), page_file("url", "title", "library", "content_hash", "crawled_at", "body").alias("text"))


def write_page_files(pages: DataFrame, folder: str) -> None:
    """One file a page below ``folder``, in a file system that executors and driver share."""
    from pyarrow import fs

    def write(rows):
        for r in rows:
            store, place = fs.FileSystem.from_uri(f"{folder}/{r.path}")
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(place) as out:
                out.write(r.text.encode())

    page_files(pages).foreachPartition(write)


def write_changed_pages(pages: DataFrame, folder: str) -> DataFrame:
    """(library, n_pages, n_changed): writes the pages whose file is missing or has another content hash.

    What a snapshot holds is what its files say, so a crawl that was cut off writes the rest next time.
    """
    spark = pages.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    stored = read_pages(spark, folder) if there else spark.createDataFrame([], "url string, content_hash string")
    old = stored.select("url", F.col("content_hash").alias("_old"))
    marked = pages.join(old, "url", "left").withColumn("changed", ~F.col("_old").eqNullSafe(F.col("content_hash"))).drop("_old")
    counts = marked.groupBy("library").agg(F.count("*").alias("n_pages"), F.count_if("changed").alias("n_changed")).collect()  # one row a library
    write_page_files(marked.where("changed").drop("changed"), folder)
    return spark.createDataFrame([tuple(r) for r in counts], "library string, n_pages long, n_changed long")


def unit_files(units: DataFrame) -> DataFrame:
    """(path, text) of each chunk as a file: front matter and content; the ordinal keeps equal anchors apart."""
    from tessera.functions.text import slug, url_stem

    stem = slug(F.concat_ws("-", url_stem(F.col("url")), F.coalesce(F.nullif("anchor", F.lit("")), F.lit("sec")), F.col("ordinal").cast("string")))
    meta = F.to_json(F.struct(*[c for c in units.columns if c not in ("content", "ordinal")]))
    return units.select(F.concat(stem, F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), meta, F.lit("\n---\n\n"), F.col("content"), F.lit("\n")).alias("text"))


def read_glosses(spark: SparkSession, path: str) -> DataFrame:
    """(url, gloss): the last line of a url counts."""
    return _last(spark, path, "url string, gloss string")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(url, questions): the last line of a url counts."""
    return _last(spark, path, "url string, questions array<string>")


def _last(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # file, split, line
    lines = spark.read.schema(schema).json(path).withColumn("_at", place)
    return last_wins(lines.where("url is not null"), "url", "_at").drop("_at")


def read_question_set(spark: SparkSession, path: str, sidecar: str | None = None) -> DataFrame:
    """(id, type, question, expected); expectations inline, or from a second file by id."""
    rows = spark.read.schema("id string, type string, question string, expected array<array<string>>").json(path)
    if sidecar is None:
        return rows
    more = spark.read.schema("id string, expected array<array<string>>").json(sidecar)
    return rows.drop("expected").join(more, "id", "left")


def read_answered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier results that have an answer; those with an error are asked again."""
    return spark.read.schema(schema).json(path).where("answer is not null")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string").json(path).where("url is not null").distinct()


def write_results(rows: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line; appending keeps what earlier batches wrote."""
    rows.write.mode("append" if append else "overwrite").json(path)
