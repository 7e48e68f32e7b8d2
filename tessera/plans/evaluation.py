"""Benchmarks over all questions of a set in one job each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import checks, metrics
from tessera.operators.retrieval import retrieve, with_content


def retrieval_benchmark(chunks: DataFrame, questions: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(per question, means) of recall and reciprocal rank; questions without expectations are left out.

    ``questions`` is a query table with ``expected``.
    """
    found = with_content(retrieve(chunks, questions, k), chunks)
    ranked = found.select(F.col("query_id").alias("id"), "rank", metrics.haystack("url", "page_title", "heading_path").alias("hay"))
    rows = metrics.question_metrics(questions.select(F.col("query_id").alias("id"), "expected"), ranked)
    return rows, metrics.mean_metrics(rows)


def coverage_benchmark(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, expected, agentic, single): citations of both answer paths as arrays of haystacks."""
    rows = answers.select("id", *[metrics.citation_coverage(F.col("expected"), F.col(c)).alias(c) for c in ("agentic", "single")])
    return rows, metrics.coverage_summary(rows)


def judge_benchmark(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, reply, latency_s): normalized scores, their means, latencies; malformed replies score NULL."""
    rows = replies.select("id", metrics.normalized_scores(metrics.parsed_scores(F.col("reply"))).alias("scores"), F.bround("latency_s", 2).alias("latency_s"))
    return rows, metrics.judge_summary(rows), metrics.latency_summary(rows)


def static_benchmark(answers: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, answer_md, symbols_used, citations): checks, share of symbols that the index knows, totals.

    ``index`` is postings; a symbol is present if some chunk has it as a lexeme.
    """
    known = index.select(F.col("lexeme").alias("symbol")).distinct().withColumn("there", F.lit(True))
    symbols = answers.select("id", F.explode("symbols_used").alias("name")).withColumn("symbol", F.lower("name"))
    rates = metrics.grounded_rate(symbols.join(known, "symbol", "left").select("id", F.coalesce("there", F.lit(False)).alias("present")))
    rows = answers.withColumn("checks", checks.run_checks("answer_md", "symbols_used")).join(rates, "id", "left")
    rows = rows.select("id", "rate", F.when(F.col("citations").isNotNull(), F.size("citations")).alias("n_citations"), "checks", checks.all_pass(F.col("checks")).alias("passed"))
    return rows, metrics.static_summary(rows)
