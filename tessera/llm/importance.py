"""Importance resampling towards a target distribution: hashed features, log-ratio gains, Gumbel top-k.

Scoring explodes nothing: higher-order functions turn a document into its array of buckets, written once,
and sum the entries of a literal array of gains at those places.  Only totals by bucket are shuffled, and rows of
a few numbers where the best are put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.words import SQL_CRC32_TABLE, SQL_WORDS, sql_crc32, words
from tessera.llm.workspace import Workspace, shuffle_width

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Of ``percentile_approx``: ranks are right to one in so many rows.
_ACCURACY = 10_000
_OWN = ("n_features", "n_words", "weight", "score")


def features(tokens: Column, max_n: int = 1) -> Column:
    """All runs of 1 to ``max_n`` consecutive words, joined by one space, repeats kept."""
    runs = [tokens]
    # words are taken by their places: a slice would copy the array for each run
    run_of = lambda n: lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)])
    for n in range(2, max_n + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, run_of(n)))
    return F.concat(*runs) if max_n > 1 else tokens


def bucketed(docs: DataFrame, key: str | None = None, text: str = "text", buckets: int = BUCKETS, max_n: int = 1) -> DataFrame:
    """(row, k, n_words, b): the columns of ``docs`` but the text as a struct, the key, and the array of the features' buckets."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    own = docs.select((F.struct(*rest) if rest else F.lit(None).cast("string")).alias("row"), (F.col(key) if key else F.lit(None)).cast("string").alias("k"), words(F.col(text)).alias("w"))
    place = lambda f: (F.crc32(f) % buckets).cast("int")
    return own.select("row", "k", F.size("w").cast("long").alias("n_words"), F.transform(features(F.col("w"), max_n), place).alias("b"))


def bucket_totals(rows: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all ``bucketed`` rows fall into it; summed before the shuffle."""
    return rows.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from two ``bucket_totals``."""
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    counts = {r.bucket: (r.s or 0, r.t or 0) for r in both.collect()}
    s_all, t_all = (sum(c) for c in zip(*counts.values()))
    ratio = lambda s, t: float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))
    return [math.floor(1000 * math.log(ratio(*counts[b]))) for b in range(buckets)]


def literal_array(numbers: list[int]) -> Column:
    """An array that Catalyst folds into one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(1000 x a standard Gumbel number) that the key and the seed fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(rows: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """(row, n_features, n_words, weight, score) of ``bucketed`` rows."""
    table = literal_array(gains)
    weight = F.aggregate("b", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    out = rows.select("row", "k", F.size("b").cast("long").alias("n_features"), "n_words", weight.alias("weight"))
    return out.select("row", "n_features", "n_words", "weight", (F.col("weight") + gumbel(F.col("k"), seed)).alias("score"))


def ranked(rows: DataFrame, space: Workspace, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` of ``scored`` with ``rank``: 1, 2, ... of the best ``percent`` of those with ``min_words`` words, null else.

    Rows that a percentile shows to be far from the best are not put in order.  The others are sorted
    by range; a row's rank is its place in its range behind the sizes of the ranges before.
    """
    enough = F.col("n_words") >= min_words
    n, low = rows.where(enough).agg(F.count("*"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 4 / _ACCURACY), _ACCURACY)).first()
    drawn = percent * n // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    top = enough & (F.col("score") >= low)
    if rows.where(top).count() < drawn:  # not within the percentile's promise
        top = enough
    order = [F.desc("score"), F.asc(F.col("row")[key])]
    placed = rows.where(top).repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = space.save(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "order")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row a partition
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    best = placed.join(before, "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))
    return best.union(rows.where(~F.coalesce(top, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, space: Workspace, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, max_n: int = 1, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(row, n_features, n_words, weight, score, rank) of every document; rank is null where it is not drawn.

    A null text has no words, weight 0 and is drawn only if ``min_words`` is 0; a null key takes the
    noise of an empty one and comes first among equal scores; repeated rows are rows of their own with
    equal scores and ranks behind each other; an empty target or table gives gains as the formula does.
    """
    rows = space.save(bucketed(docs, key, text, buckets, max_n), "buckets")
    gains = bucket_gains(bucket_totals(rows), bucket_totals(bucketed(target, None, target_text, buckets, max_n)), buckets)
    scores = space.save(scored(rows, gains, seed), "scores")
    space.drop("buckets")
    return ranked(scores, space, key, percent, min_words)


ORACLE = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT {SQL_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
f AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (
  SELECT unnest(w) AS w, 1 AS s, 0 AS t FROM d UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY 1),
h AS (SELECT w, s, t, {sql_crc32("w")} % {BUCKETS} AS bucket FROM f, {SQL_CRC32_TABLE}),
k AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM h GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM k) + {BUCKETS})::DOUBLE
                       / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM k) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM k),
weights AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
scores AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
), best AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM best) // 100 THEN rank END AS rank
FROM scores LEFT JOIN best USING (doc_id)
"""
