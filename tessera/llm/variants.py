"""Spelling variants: words one edit apart, found over forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves the first or the last half of the shorter word as it
is.  So two such words share a block of the forward dictionary (a prefix) or of the reversed one (a
suffix).  A block is (length, i, j, key): words of that length, and those one longer, whose first i and
last j code points are the key.  Blocks of too many words are cut again in the same way, at the middle
of what is still open between prefix and suffix.  Blocks are scanned as ranges of the sorted
dictionary; a pair is taken only in the block that its common prefix leads to, so it is found once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import SQL_CRC32_TABLE, ascii_lower, sql_crc32
from tessera.llm.workspace import Workspace, shuffle_width

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
EVERY = 97
#: Words of a block from which on it is cut again.  A block that is open at one code point only is not cut:
#: it has at most as many words as the alphabet has letters, and pairs of letters.
BLOCK = 128
#: Code points of a key from which on a digest stands for it.
LONG = 64
_BLOCK = ["length", "i", "j", "key"]
_CUT = r"[^A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the maximal runs of letters of all texts, ASCII letters lower-cased, with their counts.

    With ``every``, a run where crc32 of "<key>:<run>" is a multiple of it loses one code point: misspellings
    that the input fixes.  Summed before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.split(ascii_lower(F.col(text)), _CUT)).alias("run"))
    runs = runs.where(F.char_length("run") >= min_length)
    if every:
        h = F.crc32(F.concat("k", F.lit(":"), "run"))
        at = (h % F.char_length("run")).cast("int")
        runs = runs.select(F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run")).alias("run"))
        runs = runs.where(F.char_length("run") >= min_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key, in the order of the dictionaries; a digest stands for a very long one."""
    key = F.concat(F.left("word", F.col("i")), F.right("word", F.col("j")))
    return rows.withColumn("key", F.when(F.col("i") + F.col("j") <= LONG, key).otherwise(F.sha2(key, 256)))


def _halves(words: DataFrame) -> DataFrame:
    """Each word in four blocks: as the shorter and as the longer of a pair, by prefix and by suffix."""
    m = F.char_length("word")
    own = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")).withColumn("length", F.when(F.col("longer"), m - 1).otherwise(m))
    half = F.floor(F.col("length") / 2).cast("int")
    sides = F.array(F.struct(half.alias("i"), F.lit(0).alias("j")), F.struct(F.lit(0).alias("i"), (F.col("length") - half).alias("j")))
    return _keyed(own.where("length > 0").select("*", F.explode(sides).alias("s")).select("word", "n", "longer", "length", "s.i", "s.j"))


def _cut(rows: DataFrame) -> DataFrame:
    """Both parts of each block: the prefix grows by half of what is open, or the suffix by the rest."""
    opened = F.col("length") - F.col("i") - F.col("j")
    first = F.floor(opened / 2).cast("int")
    parts = F.array(F.struct((F.col("i") + first).alias("i"), F.col("j")), F.struct(F.col("i"), (F.col("j") + opened - first).alias("j")))
    return _keyed(rows.select("word", "n", "longer", "length", F.explode(parts).alias("s")).select("word", "n", "longer", "length", "s.i", "s.j"))


def near_words(words: DataFrame, space: Workspace, block: int = BLOCK) -> DataFrame:
    """(a, na, b, nb): each pair of words (word, n) that differ by one inserted, deleted or replaced code point, once."""
    rows, small, level = space.save(_halves(words), "blocks-0"), [], 0
    while True:
        large = rows.groupBy(*_BLOCK).agg(F.count("*").alias("size")).where((F.col("size") > block) & (F.col("length") - F.col("i") - F.col("j") > 1))
        large = space.save(large.select(*_BLOCK), f"large-{level}")
        small.append(rows.join(large, _BLOCK, "left_anti"))
        if large.isEmpty():
            break
        level += 1
        rows = space.save(_cut(rows.join(large, _BLOCK, "left_semi")), f"blocks-{level}")
    every = small[0]
    for more in small[1:]:
        every = every.unionByName(more)
    scan = every.repartitionByRange(shuffle_width(words.sparkSession), *_BLOCK)
    blocks = scan.groupBy(*_BLOCK).agg(F.collect_list(F.struct("word", "n", "longer")).alias("members")).where(F.size("members") > 1)
    # a common prefix that reaches the suffix belongs to the block of the longer prefix
    upto = F.col("length") - F.col("j")
    taken = lambda a, b: (b["longer"] | (b["word"] > a["word"])) & ((F.col("j") == 0) | (F.left(a["word"], upto) != F.left(b["word"], upto))) & (F.levenshtein(a["word"], b["word"], 1) == 1)
    pair = lambda a, b: F.struct(a["word"].alias("a"), a["n"].alias("na"), b["word"].alias("b"), b["n"].alias("nb"))
    pairs = F.transform(F.filter("members", lambda a: ~a["longer"]), lambda a: F.transform(F.filter("members", lambda b: taken(a, b)), lambda b: pair(a, b)))
    return blocks.select(F.explode(F.flatten(pairs)).alias("p")).select("p.*")


def _roots(rows: DataFrame, space: Workspace) -> DataFrame:
    """(word, root): forms followed to the last by pointer doubling; a form's count is at least twice its word's, so there are no circles."""
    now, k = space.save(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        k += 1
        after = space.save(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(words: DataFrame, space: Workspace, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word (word, n).

    The form is the near word of largest n, ties to the first in code-point order, if that n is at least
    ``ratio`` (over 1) times the word's own; root is where forms lead.  Words must be different; an empty table stays empty.
    """
    words = space.save(words.select("word", "n"), "words")
    pairs = space.save(near_words(words, space, block), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    taken = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    rows = space.save(rows, "forms")
    return rows.join(_roots(rows, space), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY 1, 2),
hashed AS (SELECT run, n, {sql_crc32("doc_id || ':' || run")} AS h FROM counted, {SQL_CRC32_TABLE}),
words AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {MIN_LENGTH} AND sum(n) >= {MIN_COUNT}
), less AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) u(p)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (WHERE m = top) AS other
            FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n
          FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON s.here = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)
"""
