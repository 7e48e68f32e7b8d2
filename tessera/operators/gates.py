"""Input gates: length, language, topicality, routing, rate of use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import looks_english, needs_loop
from tessera.operators.retrieval import top_distance

MESSAGES = {
    "too_long": "The question is too long; please shorten it.",
    "non_english": "Please ask in English.",
    "off_topic": "Please ask about the indexed documentation.",
}


def on_topic(distance: Column, threshold: float = Config.topicality) -> Column:
    """Near enough, or without a distance: an empty index is not the asker's fault."""
    return F.coalesce(distance <= threshold, F.lit(True))


def verdict(question: Column, distance: Column, config: Config = Config()) -> Column:
    """struct(ok, reason, message), the cheapest test first."""
    if not config.guard:
        reason = F.lit("")
    else:
        reason = F.when(F.char_length(question) > config.question_chars, "too_long").when(~looks_english(question), "non_english").when(~on_topic(distance, config.topicality), "off_topic").otherwise("")
    message = F.coalesce(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[reason], F.lit(""))
    return F.struct((reason == "").alias("ok"), reason.alias("reason"), message.alias("message"))


def guarded(queries: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds ``verdict``; distances are computed only for questions that pass the cheap gates."""
    cheap = (F.char_length("query") <= config.question_chars) & looks_english(F.col("query"))
    near = top_distance(chunks, queries.where(cheap))
    return queries.join(near, "query_id", "left").withColumn("verdict", verdict(F.col("query"), F.col("dist"), config))


def routed(queries: DataFrame) -> DataFrame:
    return queries.withColumn("route", F.when(needs_loop(F.col("query")), "loop").otherwise("single"))


def available(providers: DataFrame, now: Column) -> DataFrame:
    """Providers that are not cooling down; all of them if all are (``until`` is NULL where none is set)."""
    marked = providers.withColumn("cooling", F.coalesce(F.col("until") > now, F.lit(False)))
    all_cool = F.min(F.col("cooling").cast("int")).over(Window.partitionBy("chain")) == 1
    return marked.withColumn("_all", all_cool).where(~F.col("cooling") | F.col("_all")).drop("cooling", "_all")
