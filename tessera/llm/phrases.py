"""Phrase and proximity search over a positional inverted index, and benchmark decontamination by it.

DataFrame functions only.  The index is a written table of postings (document, place, word) of the
training texts, cut by documents: a phrase lies in one document, so nothing is gathered by word and
no list of a frequent word meets in one task.  A phrase is looked up by its rarest words: their
postings, moved back by the word's offset in the phrase, must agree on where the phrase starts; what
agrees is compared with the words of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import SQL_WORDS, words
from tessera.llm.workspace import Workspace

WINDOW = 10
#: Rarest words of a phrase whose posting lists are intersected.
RAREST = 2
_DOC = ["k", "t"]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, text): rows are told apart by key and a hash of the text."""
    return docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k")) & (F.col(f"{a}.t") == F.col(f"{b}.t"))


class PhraseIndex:
    """Postings of the words of ``docs``: (k, t, pos, term), k the key, t a hash of the text, pos from 0.

    With ``vocabulary`` (term) only of these words, for searches of known phrases.
    """

    def __init__(self, docs: DataFrame, space: Workspace, vocabulary: DataFrame | None = None, key: str = "doc_id", text: str = "text"):
        self.docs, self.space = _keyed(docs, key, text), space
        rows = self.docs.select(*_DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))
        if vocabulary is not None:
            rows = rows.join(space.save(vocabulary.select("term").distinct(), "vocabulary"), "term", "left_semi")
        self.postings = space.save(rows.select(*_DOC, "pos", "term"), "postings")
        self.frequencies = space.save(self.postings.groupBy("term").agg(F.count("*").alias("tf")), "frequencies")

    def _plans(self, phrases: DataFrame) -> DataFrame:
        """(id, off, term, nth): the words of each phrase from the rarest on, of phrases whose words all occur."""
        terms = phrases.select("id", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
        known = terms.join(self.frequencies, "term").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("tf", "off", "term"))).alias("plan"))
        return known.where(F.size("plan") == F.col("n")).select("id", F.posexplode("plan").alias("nth", "p")).select("id", "nth", "p.off", "p.term")

    def starts(self, phrases: DataFrame, rarest: int = RAREST) -> DataFrame:
        """(id, k, t, start): where the lists of the ``rarest`` words of a phrase (id, words) agree on a start."""
        plans = self.space.save(self._plans(phrases).where(F.col("nth") < rarest), "plans")
        wanted = plans.groupBy("id").agg(F.count("*").cast("int").alias("lists"))
        moved = self.postings.join(plans, "term").where("pos >= off").select("id", *_DOC, (F.col("pos") - F.col("off")).alias("start"), "nth")
        met = moved.groupBy("id", *_DOC, "start").agg(F.bit_or(F.expr("shiftleft(1, nth)")).alias("met"))
        return met.join(wanted, "id").where(F.expr("met = shiftleft(1, lists) - 1")).select("id", *_DOC, "start")

    def texts_with_hits(self, phrases: DataFrame) -> DataFrame:
        """(k, t, n_words, hits) of every text: hits are (start, length, id) of all phrases (id, words), by start.

        Whole texts are read and, where ``starts`` found something, compared word by word.
        """
        said = self.space.save(phrases.select("id", F.size("words").alias("length"), "words"), "phrases")
        found = self.starts(phrases).join(said, "id").groupBy(*_DOC).agg(F.collect_list(F.struct("start", "length", "id", "words")).alias("maybe"))
        found = self.space.save(found, "maybe")
        both = self.docs.alias("d").join(found.alias("f"), _same("d", "f"), "left").select("d.k", "d.t", words(F.col("text")).alias("w"), "maybe")
        # word by word at its place: a slice would copy the whole text's array
        real = F.filter("maybe", lambda m: F.forall(F.sequence(F.lit(0), m["length"] - 1), lambda j: F.get("w", m["start"] + j).eqNullSafe(F.get(m["words"], j))))
        hits = F.array_sort(F.transform(real, lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"), m["id"].alias("id"))))
        return both.select("k", "t", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))

    def phrase_matches(self, phrases: DataFrame) -> DataFrame:
        """(id, k, start, length): every occurrence of every phrase (id, words), exact; of equal rows one."""
        rows = self.texts_with_hits(phrases.where(F.size("words") > 0)).select("k", "t", F.explode("hits").alias("h"))
        return rows.distinct().select("h.id", "k", "h.start", "h.length")

    def proximity_matches(self, phrases: DataFrame, span: int) -> DataFrame:
        """(id, k, at, start): occurrences ``at`` of the rarest word of a set of words (id, words) such that all of its
        words lie, in any order, in some ``span`` consecutive words with it; ``start`` is where the first such span starts.

        Postings meet by word and block of ``span`` places, so lists are never compared as a whole.
        """
        sets = phrases.select("id", F.array_distinct("words").alias("words")).where(F.size("words") > 0)
        plans = self.space.save(self._plans(sets), "sets")
        block = lambda c: F.floor(c / span).cast("long")
        first = self.postings.join(plans.where("nth = 0"), "term").select("id", *_DOC, F.col("pos").alias("at"))
        others = first.join(plans.where("nth > 0"), "id").withColumn("near", F.explode(F.array(*[block(F.col("at")) + d for d in (-1, 0, 1)])))
        there = self.postings.distinct().withColumn("near", block(F.col("pos")))
        met = others.alias("o").join(there.alias("p"), _same("o", "p") & (F.col("o.term") == F.col("p.term")) & (F.col("o.near") == F.col("p.near")))
        met = met.where(F.abs(F.col("p.pos") - F.col("o.at")) < span).groupBy("o.id", "o.k", "o.t", "o.at", "o.nth").agg(F.collect_set("p.pos").alias("places"))
        met = met.groupBy("id", *_DOC, "at").agg(F.collect_list("places").alias("lists"))
        wanted = plans.groupBy("id").agg((F.count("*") - 1).alias("others"))
        every = first.distinct().alias("a").join(wanted, "id").join(met.alias("m"), (F.col("a.id") == F.col("m.id")) & _same("a", "m") & (F.col("a.at") == F.col("m.at")), "left")
        every = every.select("a.id", "a.k", "a.at", "others", F.coalesce("lists", F.array().cast("array<array<int>>")).alias("lists")).where(F.size("lists") == F.col("others"))
        covers = lambda s: F.forall("lists", lambda ps: F.exists(ps, lambda p: (p >= s) & (p < s + span)))
        starts = F.filter(F.sequence(F.greatest(F.col("at") - span + 1, F.lit(0)), F.col("at")), covers)
        return every.select("id", "k", "at", F.get(starts, 0).alias("start")).where("start is not null")


def item_windows(items: DataFrame, space: Workspace, window: int = WINDOW, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, words), the different windows of all items, and (id, item), the items of each.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one.
    """
    own = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    last = lambda s: F.least(s + window, F.size("w")) - 1
    cut = own.select("item", F.explode(F.transform(starts, lambda s: F.transform(F.sequence(s, last(s)), lambda j: F.get("w", j)))).alias("words")).distinct()
    cut = space.save(cut, "windows")
    phrases = space.save(cut.select("words").distinct().select(F.monotonically_increasing_id().alias("id"), "words"), "window_ids")
    return phrases, cut.join(phrases, "words").select("id", "item")


def contamination(docs: DataFrame, items: DataFrame, space: Workspace, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``.

    n_hit counts the words inside any occurrence of a window, items are the ids of the items with such
    windows, as ascending strings.  Null and empty texts have no words and no hits; an item without words
    has no window, a null item id counts as an empty one and equal ids as one item; rows with equal key
    and text get equal results, null keys too; without items nothing is hit.
    """
    phrases, owners = item_windows(items, space, window, item, item_text)
    index = PhraseIndex(docs, space, phrases.select(F.explode("words").alias("term")), key, text)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    cover = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(h["start"], a["end"]))).alias("n"), F.greatest(a["end"], h["start"] + h["length"]).alias("end"))
    n_hit = F.coalesce(F.aggregate("hits", start, cover, lambda a: a["n"]), F.lit(0))
    ids = F.array_distinct(F.transform("hits", lambda h: h["id"]))
    texts = space.save(index.texts_with_hits(phrases).select("k", "t", "n_words", n_hit.alias("n_hit"), ids.alias("ids")), "hits")
    named = texts.select("k", "t", F.explode("ids").alias("id")).join(owners, "id").select("k", "t", "item").distinct()
    named = named.groupBy("k", "t").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = texts.alias("a").join(named.alias("b"), _same("a", "b"), "left")
    items_ = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return both.select(F.col("a.k").alias(key), "n_words", "n_hit", F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS p, least(len(w), {WINDOW}) AS l
        FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) u(s) WHERE len(w) > 0),
d AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
pos AS (SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS p
        FROM d, (SELECT DISTINCT l FROM win) v, unnest(range(1, len(w) - l + 2)) u(s)),
hit AS (SELECT doc_id, s, l, item FROM pos JOIN win USING (p, l)),
covered AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM hit, unnest(range(l)) u(o) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
