"""Rollups of the index and of inventories, coverage gaps, and resumable work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The roles of documented objects that have pages of their own.
PAGE_ROLES = ("py:class", "py:function", "py:method", "py:module", "py:attribute", "std:doc")


def page_rollup(chunks: DataFrame, headings: int = 40) -> DataFrame:
    """(library, kind, url, page_title, n_chunks, headings): chunks with a heading, or 1; the first distinct headings.

    A page's title, kind and library are those of its first chunk by key.
    """
    first = F.min_by(F.struct("library", "kind", "page_title"), F.col("chunk_key")).alias("f")
    rows = chunks.groupBy("url").agg(first, F.greatest(F.count_if(F.col("heading_path") != ""), F.lit(1)).alias("n_chunks"))
    known = chunks.select("url", F.nullif("heading_path", F.lit("")).alias("h")).where("h is not null").distinct()
    # a window that is cut by its rank keeps no more than that many rows a page in each task before the shuffle
    few = known.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("h"))).where(F.col("_n") <= headings)
    lists = few.groupBy("url").agg(F.array_sort(F.collect_list("h")).alias("headings")).withColumnRenamed("url", "_url")
    both = rows.join(lists, F.col("url").eqNullSafe(F.col("_url")), "left")
    return both.select("f.library", "f.kind", "url", "f.page_title", "n_chunks", F.coalesce("headings", F.array().cast("array<string>")).alias("headings"))


def pages_by_kind(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("kind").agg(F.count("*").alias("pages"))


def coverage_gap(site: DataFrame, indexed: DataFrame) -> DataFrame:
    """Site urls that the index has not."""
    return site.join(indexed.select("url").distinct(), "url", "left_anti")


def gap_by_library(gap: DataFrame) -> DataFrame:
    return gap.groupBy("library").agg(F.count("*").alias("missing")).orderBy(F.desc("missing"), "library")


def remaining(work: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Work whose key was not done before."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def preferred_inventory(entries: DataFrame) -> DataFrame:
    """One entry a (url, anchor, name); one that is not from a sitemap goes before one that is, later before earlier."""
    by = Window.partitionBy("url", "anchor", "name").orderBy(F.col("role") == "sitemap", F.desc("ord"))
    return entries.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def documented(entries: DataFrame, roles: tuple[str, ...] = PAGE_ROLES) -> DataFrame:
    return entries.where(F.col("role").isin(*roles) & F.endswith(F.col("page_url"), F.lit(".html")))


def api_excerpts(pages: DataFrame, chars: int = 1500) -> DataFrame:
    """API pages with a flat excerpt, core pages first."""
    flat = F.trim(F.regexp_replace(F.substring("body", 1, chars), r"\s+", " "))
    from tessera.functions.text import page_kind

    return pages.where(page_kind(F.col("url")) == "api").select("url", flat.alias("excerpt")).orderBy(F.when(F.col("url").contains("/docs/"), 0).otherwise(1), "url")


def first_sections(sections: DataFrame) -> DataFrame:
    """Sections of several searches: the first by arrival of each (url, anchor)."""
    by = Window.partitionBy("query_id", "url", "anchor").orderBy("arrival")
    return sections.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of distinct keys in the order in which they came first."""
    return rows.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an explicit order, all of them for 0."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows.orderBy(*order)


def grounded_groups(expected: DataFrame, inventory: DataFrame, name: str = "name") -> DataFrame:
    """(id, group) of expected groups with a pattern that occurs in some inventory name, whatever the case.

    ``expected`` is (id, expected array<array<string>>).  Distinct names are searched once for all distinct patterns.
    """
    from tessera.operators.patterns import occurrences

    groups = expected.select("id", F.posexplode("expected").alias("group", "patterns")).select("id", "group", F.explode("patterns").alias("p")).withColumn("p", F.lower("p"))
    names = inventory.select(F.lower(name).alias("hay")).distinct()
    found = occurrences(names, F.col("hay"), groups.where("p <> ''").select("p"), "p").select("p").distinct()
    return groups.join(found, "p", "left_semi").select("id", "group").distinct()


def dump(rows: DataFrame, path: str, *order: str) -> None:
    """One JSON object a line, in order within and over files."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)
