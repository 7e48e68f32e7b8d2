"""Evaluation: recall and reciprocal rank, coverage, judge scores, latencies, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JUDGE = "faithfulness struct<score:int,why:string>, relevance struct<score:int,why:string>, citation struct<score:int,why:string>"
DIMENSIONS = ("faithfulness", "relevance", "citation")


def haystack(*fields: str) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def group_hits(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id, group, first_rank): first rank whose haystack holds any pattern of each expected group.

    ``expected`` is (id, expected array<array<string>>), ``ranked`` (id, rank, hay).  Results and groups meet by
    question and only ranks go on, so nothing of a question is gathered.
    """
    groups = expected.select("id", F.posexplode("expected").alias("group", "patterns"))
    fits = F.exists("patterns", lambda p: F.contains(F.col("hay"), F.lower(p)))
    first = groups.join(ranked, "id").where(fits).groupBy("id", "group").agg(F.min("rank").alias("first_rank"))
    return groups.select("id", "group").join(first, ["id", "group"], "left")


def question_metrics(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id, recall, mrr, ranks) for questions with expected groups; recall is the share of groups met,
    mrr the reciprocal of the best rank of any group."""
    hits = group_hits(expected.where(F.size("expected") > 0), ranked)
    return hits.groupBy("id").agg(
        F.avg(F.col("first_rank").isNotNull().cast("double")).alias("recall"),
        F.coalesce(1.0 / F.min("first_rank"), F.lit(0.0)).alias("mrr"),
        F.transform(F.array_sort(F.collect_list(F.struct("group", "first_rank"))), lambda x: x["first_rank"]).alias("ranks"),
    )


def mean_metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("questions"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.count_if(F.col("recall") == 0).alias("zero_recall"))


def citation_coverage(expected: Column, hays: Column) -> Column:
    """Share of groups with a pattern in some citation; 0 without groups."""
    hit = lambda g: F.exists(g, lambda p: F.exists(hays, lambda h: F.contains(h, F.lower(p))))
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, hit)) / F.size(expected)).otherwise(F.lit(0.0))


def coverage_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("agentic").alias("agentic"), F.avg("single").alias("single"), F.avg(F.col("agentic") - F.col("single")).alias("delta"))


def parsed_scores(reply: Column) -> Column:
    """The judge's scores; NULL unless all three are whole numbers of 1 to 5."""
    from tessera.functions.text import json_object

    found = F.from_json(json_object(reply), JUDGE)
    good = F.lit(True)
    for d in DIMENSIONS:
        good &= F.coalesce(found[d]["score"].between(1, 5), F.lit(False))
    return F.when(good, found)


def normalized_scores(scores: Column) -> Column:
    """Each dimension on 0 to 1, and their mean."""
    parts = [((scores[d]["score"] - 1) / 4.0) for d in DIMENSIONS]
    return F.when(scores.isNotNull(), F.struct(*[p.alias(d) for p, d in zip(parts, DIMENSIONS, strict=True)], ((parts[0] + parts[1] + parts[2]) / 3.0).alias("overall")))


def judge_summary(rows: DataFrame) -> DataFrame:
    """Means over the rows that have scores."""
    return rows.agg(F.count("scores").alias("scored"), *[F.avg(f"scores.{d}").alias(d) for d in (*DIMENSIONS, "overall")])


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place floor(p n) of n sorted ones (the last at most); not interpolated."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, (F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * F.lit(p))) + 1).cast("int"))


#: Cells of the histogram that brackets a rank, and the accuracy of its edges: their ranks are a sixteenth of a
#: cell off at most, and a bracket has a whole cell to spare on either side.
_GRID, _ACCURACY = 1 << 10, 1 << 14


def latency_summary(rows: DataFrame, value: str = "latency_s", by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank percentiles, largest and mean: (by, n, p50, p95, max, mean).

    Exact without sorting a group: approximate quantiles give a bracket of a few cells around each rank, with their
    error on either side; rows outside the brackets are counted in the map, by side, and only distinct values
    inside meet in order.  Null values count as rows before all others, never as a percentile.
    """
    grid = [g / _GRID for g in range(_GRID + 1)]
    edges = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("_all"), F.count(value).alias("_some"), F.max(value).alias("_max"), F.sum(value).alias("_sum"), F.percentile_approx(value, grid, _ACCURACY).alias("_grid"))
    target = lambda p: F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p)))
    cell = lambda p: F.floor(F.greatest(F.lit(0), target(p) - F.col("_all") + F.col("_some")) / F.nullif("_some", F.lit(0)) * _GRID).cast("int")
    edge = lambda at: F.get("_grid", F.greatest(F.lit(0), F.least(F.lit(_GRID), at)))
    edges = edges.select("*", *[edge(cell(p) + step).alias(name) for p, step, name in ((0.5, -1, "_lo50"), (0.5, 2, "_hi50"), (0.95, -1, "_lo95"), (0.95, 2, "_hi95"))]).drop("_grid")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    both = rows.select(*by, value).join(edges, same) if by else rows.select(value).crossJoin(F.broadcast(edges))  # one row
    v = F.col(value)
    side = F.when(v.isNull(), -1).when(v < F.col("_lo50"), 0).when(v <= F.col("_hi50"), 1).when(v < F.col("_lo95"), 2).when(v <= F.col("_hi95"), 3).otherwise(4)
    facts = ["_all", "_max", "_sum"]
    counted = both.withColumn("_side", side).groupBy(*by, *facts, "_side", F.when(F.col("_side").isin(1, 3), v).alias("_value")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = lambda p: F.min(F.when(F.col("_upto") > target(p), F.col("_value")))
    placed = counted.withColumn("_upto", upto)
    return placed.groupBy(*by).agg(F.max("_all").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("_max").alias("max"), (F.max("_sum") / F.max("_all")).alias("mean"))


def grounded_rate(symbols: DataFrame) -> DataFrame:
    """(id, rate) of (id, present): share of symbols that the index has; NULL without symbols."""
    return symbols.groupBy("id").agg(F.avg(F.col("present").cast("double")).alias("rate"))


def static_summary(rows: DataFrame) -> DataFrame:
    """Over (rate, n_citations, passed)."""
    return rows.agg(F.avg("rate").alias("rate"), F.avg("n_citations").alias("citations"), F.count_if("passed").alias("passed"))


def distance_listing(distances: DataFrame) -> DataFrame:
    """(group, question, dist): nearest first, those without a distance last."""
    order = [F.asc_nulls_last("dist"), F.asc("question")]
    return distances.orderBy(*order).select("group", "question", "dist")


def citation_hays(citations: Column) -> Column:
    """What is searched of each citation: url, anchor and title in lower case."""
    return F.transform(citations, lambda c: F.lower(F.concat_ws(" ", c["url"], c["anchor"], c["title"])))


def judge_prompt(question: Column, context: Column, answer: Column, citations: Column) -> Column:
    """What a judge reads: the question, the sections shown, the answer and its citations, each under its name."""
    cited = F.transform(citations, lambda c: F.concat(F.lit("  - "), c["url"], F.lit("#"), c["anchor"], F.lit(" ("), c["title"], F.lit(")")))
    block = lambda name, body, none: F.concat(F.lit(f"{name}:\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit(none)))
    return F.concat_ws("\n\n", block("QUESTION", question, ""), block("CONTEXT SECTIONS", context, "(none retrieved)"), block("ANSWER", answer, ""), block("ANSWER CITATIONS", F.array_join(cited, "\n"), "  (none)"))


def calibration(distances: DataFrame) -> DataFrame:
    """One row: least, largest and mean distance of each group, and the threshold between on and off topic.

    ``distances`` is (group in on/borderline/off, dist); the threshold is NULL where groups overlap.
    """
    picks = [f(F.when(F.col("group") == g, F.col("dist"))).alias(f"{g}_{n}") for g in ("on", "borderline", "off") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    one = distances.agg(*picks)
    return one.withColumn("threshold", F.when(F.col("on_max") < F.col("off_min"), (F.col("on_max") + F.col("off_min")) / 2))


def repeated_ids(questions: DataFrame) -> DataFrame:
    """Ids that occur more than once, and questions without expected groups: what a sound set has not."""
    twice = questions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("fault"))
    empty = questions.where(F.coalesce(F.size("expected"), F.lit(0)) <= 0).select("id", F.lit("no groups").alias("fault"))
    return twice.union(empty)
