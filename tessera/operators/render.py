"""Answers, traces and budgets of many questions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import html_escape
from tessera.plans.answering import ANSWER, BUDGETS, MAX_STEPS

LICENCE = "<sub>Documentation quoted under its own licence</sub>"
_STYLE = "color:var(--body-text-color-subdued)"


def answer_markdown(answer: Column, citations: Column, referrals: Column, version: Column, licence: str = LICENCE) -> Column:
    """An answer with its sources, links beyond them, the version it is for and the licence of what it quotes.

    Blocks without content are left out; a citation is named by its title or else its url, a link by its
    reason or else its url.
    """
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    anchor = lambda c: F.coalesce(F.concat(F.lit("#"), F.nullif(c["anchor"], F.lit(""))), F.lit(""))
    source = lambda c: F.concat(F.lit("- ["), filled(c["title"], c["url"]), F.lit("]("), c["url"], anchor(c), F.lit(")"))
    link = lambda r: F.concat(F.lit("- ["), filled(r["reason"], r["url"]), F.lit("]("), r["url"], F.lit(")"))
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    blocks = F.array(
        answer,
        F.when(some(citations), F.concat(F.lit("\n---\n**Sources**\n"), F.array_join(F.transform(citations, source), "\n"))),
        F.when(some(referrals), F.concat(F.lit("\n**Beyond these docs**\n"), F.array_join(F.transform(referrals, link), "\n"))),
        F.when((version != "") & (version != "unknown"), F.concat(F.lit("\n<sub>for version "), version, F.lit("</sub>"))),
        F.when(some(citations), F.lit("\n" + licence)),
    )
    return F.array_join(F.array_compact(blocks), "\n")


def trace_html(steps: Column, spinner: Column) -> Column:
    """Steps of a question as one grey block, escaped, a spinner behind them while it is at work."""
    rows = F.array_compact(F.array_append(F.transform(steps, html_escape), spinner))
    shown = F.when(F.size(rows) > 0, F.array_join(rows, "<br>")).otherwise("…")
    return F.concat(F.lit(f'<span style="{_STYLE}">'), shown, F.lit("</span>"))


def budgeted(actions: DataFrame) -> DataFrame:
    """(id, step, action, outcome) of planned actions (id, step, action) of many questions at once.

    A question has used one search before its first step.  An action within its tool's budget is
    ``used``, one beyond it ``refused``; the first that is no tool, the first step with all budgets spent and
    the first beyond ``MAX_STEPS`` end the question: that row is ``answer``, later ones drop out.
    """
    order = Window.partitionBy("id").orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda name: F.coalesce(F.sum((F.col("action") == name).cast("int")).over(before), F.lit(0)) + int(name == "search_docs")
    rows = actions.withColumns({"_n": F.row_number().over(order), **{f"_{t}": count(t) for t in BUDGETS}})
    spent = F.lit(True)
    room = F.lit(False)
    for tool, n in BUDGETS.items():
        spent &= F.col(f"_{tool}") >= n
        room |= (F.col("action") == tool) & (F.col(f"_{tool}") < n)
    ends = F.coalesce(~F.col("action").isin(*BUDGETS), F.lit(True)) | spent | (F.col("_n") > MAX_STEPS)
    marked = rows.withColumn("outcome", F.when(ends, ANSWER).when(room, "used").otherwise("refused"))
    ended = F.coalesce(F.max((F.col("outcome") == ANSWER).cast("int")).over(before), F.lit(0))
    return marked.withColumn("_ended", ended).where("_ended = 0").select("id", "step", "action", "outcome")
