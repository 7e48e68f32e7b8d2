"""Which of many strings occur in each text: one automaton over all patterns, one pass over the texts.

Patterns are searched as they are; lower both sides for a search that ignores case.  The distinct patterns go
to the tasks in parts of at most ``PART_BYTES``, which bounds what the driver holds and what an automaton
takes in a worker; thousands of patterns cost one pass.  Patterns of more than one part are looked up in the distinct
pieces of the texts instead, so that texts are read twice, however many patterns there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.streaming.runs import folder
from tessera.workers import kept

#: UTF-8 bytes of the patterns of one automaton, whose nodes take about a hundred times as much.
PART_BYTES = 1 << 20
#: Characters of a piece of text whose substrings are joined with the patterns; longer ones are searched.
PIECE_CHARS = 64


def _distinct(patterns: DataFrame) -> DataFrame:
    return patterns.select(F.col(patterns.columns[0]).alias("p")).where("p is not null").distinct()


def _size(known: DataFrame) -> int:
    return known.agg(F.sum(F.octet_length("p") + 1).alias("b")).first().b or 0


def _parts(known: DataFrame) -> list[list[str]]:
    """Distinct patterns in lists of bounded size, by a hash; one list at a time comes from its own filter."""
    size = _size(known)
    n = max(1, -(-2 * size // PART_BYTES)) if size > PART_BYTES else 1
    part = F.pmod(F.xxhash64("p"), F.lit(n))
    return [sorted(r.p for r in known.where(part == i).collect()) for i in range(n)] if size else []


def _automaton(words: list[str], name: str):
    import ahocorasick

    memo = kept("patterns")
    if name not in memo:
        memo.clear()
        made = ahocorasick.Automaton()
        for i, w in enumerate(words):
            if w:
                made.add_word(w, i)
        made.make_automaton()
        memo[name] = made
    return memo[name]


def _search(words: list[str]):
    name = hashlib.sha256("\0".join(words).encode("utf-8", "surrogatepass")).hexdigest()
    always = [i for i, w in enumerate(words) if not w]

    @pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = _automaton(words, name)
        for texts in batches:
            found = []
            for t in texts:
                hits = set(always) if t is not None else set()
                if t and len(made):
                    hits.update(i for _, i in made.iter(t))
                found.append([words[i] for i in sorted(hits)])
            yield pd.Series(found, index=texts.index, dtype=object)

    return run


def occurrences(texts: DataFrame, text: Column, patterns: DataFrame, name: str = "pattern") -> DataFrame:
    """The columns of ``texts`` and ``name``: a row for each distinct pattern (first column of ``patterns``) that
    ``text`` holds.

    Null texts hold nothing and null patterns are nowhere; an empty pattern is in every text; repeated rows
    are rows of their own.  Without patterns the result is empty.
    """
    known = _distinct(patterns)
    if _size(known) > PART_BYTES:
        return _by_pieces(texts, text, known, name)
    return _by_automata(texts, text, known, name)


def _by_automata(texts: DataFrame, text: Column, known: DataFrame, name: str) -> DataFrame:
    """One pass over ``texts`` for each part of the patterns."""
    out = None
    for words in _parts(known):
        found = texts.withColumn(name, F.explode(_search(words)(text)))
        out = found if out is None else out.unionByName(found)
    return texts.withColumn(name, F.lit("")).where("false") if out is None else out


def _pieces_of(alphabet: str, least: int):
    """Distinct runs of letters of ``alphabet`` in a text, of at least ``least`` characters."""
    run_of = re.compile("[" + "".join(map(re.escape, alphabet)) + "]{" + str(max(1, least)) + ",}")

    @pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else list(set(run_of.findall(t))) for t in texts], index=texts.index, dtype=object)

    return run


def _by_pieces(texts: DataFrame, text: Column, known: DataFrame, name: str) -> DataFrame:
    """Patterns of more than one part: a pattern lies in one run of its own letters, so distinct runs are searched, not
    texts.  A short run's substrings are joined with the patterns; longer runs go through the automata."""
    spark = texts.sparkSession
    letters = known.select(F.explode(F.split("p", "")).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r.c for r in letters.collect()))  # at most the characters that there are
    lengths = sorted(r.n for r in known.where("p <> ''").select(F.char_length("p").alias("n")).distinct().where(F.col("n") <= PIECE_CHARS).collect())  # at most PIECE_CHARS
    least = known.where("p <> ''").agg(F.min(F.char_length("p")).alias("n")).first().n
    # a row's number joins nothing, it only tells repeated rows apart
    rows = texts.withColumns({"_row": F.monotonically_increasing_id(), "_pieces": _pieces_of(alphabet, least)(text)})
    at = folder(spark, "pieces")
    rows.select(F.explode("_pieces").alias("piece")).distinct().write.parquet(at)
    pieces = spark.read.schema("piece string").parquet(at)
    short = pieces.where(F.char_length("piece") <= PIECE_CHARS)
    starts = F.sequence(F.lit(1), F.char_length("piece") - F.col("n") + 1)
    sized = short.withColumn("n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where("n <= char_length(piece)")
    inside = sized.select("piece", F.explode(starts).alias("i"), "n").select("piece", F.substring("piece", F.col("i"), F.col("n")).alias("p"))
    held = inside.join(known, "p", "left_semi").distinct()
    long = pieces.where(F.char_length("piece") > PIECE_CHARS)
    if not long.isEmpty():
        held = held.unionByName(_by_automata(long, F.col("piece"), known.where("p <> ''"), "p"))
    held_at = folder(spark, "held")
    held.write.parquet(held_at)
    held = spark.read.schema("piece string, p string").parquet(held_at).withColumnsRenamed({"piece": "_piece", "p": "_p"})
    out = rows.withColumn("_piece", F.explode("_pieces")).join(held, "_piece").dropDuplicates(["_row", "_p"])
    out = out.select(*[c for c in texts.columns if c != name], F.col("_p").alias(name))
    always = texts.where(text.isNotNull()).withColumn(name, F.lit("")).select(*out.columns)
    return out.unionByName(always) if not known.where("p = ''").isEmpty() else out
