"""Line dedup: boilerplate lines by the number of distinct sites that carry them.  DataFrame functions only.

A line's sites are counted by HyperLogLog sketches that merge in the aggregation, so what a line
costs does not grow with the rows that carry it.  Lines whose estimate lies within ``margin`` of
the threshold are counted again exactly; beyond the margin (over ten standard errors of the sketch)
the estimate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 10
_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """Adds nothing but (a, b), a 128-bit hash of each non-blank line, and its place."""
    line = F.trim(F.col("_line"))
    return docs.select("*", F.posexplode(_lines(F.col(text))).alias("_pos", "_line")).where(line != "").withColumns({"_a": F.xxhash64(line), "_b": F.xxhash64(F.lit(7), line)}).drop("_line", text)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = 0.25, site: str = "source", text: str = "text") -> DataFrame:
    """(_a, _b): hashes of the lines that at least ``min_sites`` distinct sites carry."""
    lines = _hashed(docs.select(F.col(site).alias("site"), F.col(text).alias("text")).where("site is not null"), "text")
    spread = lines.groupBy("_a", "_b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(_K))).alias("sites"))
    close = spread.where(F.col("sites") >= min_sites * (1 - margin))
    sure = close.where(F.col("sites") > min_sites * (1 + margin)).select("_a", "_b")
    near = close.where(F.col("sites") <= min_sites * (1 + margin)).select("_a", "_b")
    # only rows of lines near the threshold go on, and each task sends a line and site once
    exact = lines.select("_a", "_b", "site").join(near, ["_a", "_b"], "left_semi").distinct().groupBy("_a", "_b").agg(F.count("*").alias("n"))
    return sure.union(exact.where(F.col("n") >= min_sites).select("_a", "_b"))


def remove_boilerplate(docs: DataFrame, space, min_sites: int = MIN_SITES, key: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """(row, n_lines, n_removed, kept): the input's columns as a struct, line counts, the text that stays.

    A line is what stands between line feeds, compared without leading and trailing blanks; blank
    lines are never removed.  A null text has no lines and stays null; a row with a null site counts
    for no site but loses boilerplate too; equal rows get equal results; null keys are kept apart by
    their text's hash.  An empty table stays empty.
    """
    cut = space.save(boilerplate(docs, min_sites, site=site, text=text), "boilerplate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    hit = _hashed(rows.select("k", "t", "text"), "text").join(cut, ["_a", "_b"])
    gone = hit.groupBy("k", "t").agg(F.array_sort(F.collect_set("_pos")).alias("gone")).select(F.col("k").alias("gk"), F.col("t").alias("gt"), "gone")
    both = rows.join(gone, F.col("k").eqNullSafe(F.col("gk")) & (F.col("t") == F.col("gt")), "left")
    both = both.select("row", "text", "gone", _lines(F.col("text")).alias("lines"))
    # what stays are the runs of lines between two removed ones
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get("gone", j - 1) + 1)
    end = lambda j: F.coalesce(F.get("gone", j), F.size("lines"))
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda j: F.slice("lines", begin(j) + 1, end(j) - begin(j)))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    count = lambda a: F.when(F.col(a).isNull(), 0).otherwise(F.size(a)).cast("long")
    return both.select("row", count("lines").alias("n_lines"), count("gone").alias("n_removed"), kept.alias("kept"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), cut AS (
  SELECT trim(line) AS t FROM lines WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(cut.t) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE cut.t IS NULL), '') AS kept
  FROM lines LEFT JOIN cut ON trim(line) = cut.t GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
