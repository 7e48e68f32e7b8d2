"""Generated glosses and questions of pages: prompts in batches, tolerant replies, results kept batch by batch."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import valid_items
from tessera.operators.chunking import batch_prompts
from tessera.operators.manifest import remaining
from tessera.sources.snapshot import read_urls, write_results

#: Consecutive batches without a usable reply after which a run stops.
STOP_AFTER = 5


def git_checkpoint(folder: str, label: str, push: bool = True) -> bool:
    """Commit what changed below ``folder``, and push it where there is a remote; False if nothing changed."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    git("add", "-A", ".")
    if git("diff", "--cached", "--quiet").returncode == 0:
        return False
    done = git("-c", "user.name=checkpoint", "-c", "user.email=checkpoint@localhost", "commit", "-m", label).returncode == 0
    if done and push and git("remote").stdout.strip():
        git("push")
    return done


def enrich(pages: DataFrame, path: str, ask: Callable[[str], str], value: str, size: int, limit: int, most: int | None = None, checkpoint: Callable[[int], None] = lambda n: None) -> dict[str, int]:
    """Ask for each batch of the pages (url, excerpt) that ``path`` does not cover, and append its results there.

    ``value`` names the field of a reply's items and the column of a result; with ``most`` it is a list.
    A reply's items are read by ``valid_items``.  Batches come one after the other; a run that was cut off,
    or that stopped after ``STOP_AFTER`` failures in a row, goes on with what is not covered.
    """
    spark: SparkSession = pages.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    todo = remaining(pages, read_urls(spark, path)) if there else pages
    batches = batch_prompts(todo, size, ["url"], urls=True)
    done = failed = in_a_row = 0
    for row in batches.orderBy("part", "batch").toLocalIterator():
        try:
            reply = spark.createDataFrame([(ask(row.prompt), row.urls)], "reply string, urls array<string>")
            found = reply.select("urls", F.explode(valid_items(F.col("reply"), F.size("urls"), value, limit, most)).alias("x"))
            got = F.col("x.values") if most else F.get("x.values", 0)
            rows = found.select(F.element_at("urls", (F.col("x.i") + 1).cast("int")).alias("url"), got.alias(value))
            n = rows.count()
        except Exception:
            n = 0
        if not n:
            failed, in_a_row = failed + 1, in_a_row + 1
            if in_a_row >= STOP_AFTER:
                break
            continue
        write_results(rows.coalesce(1), path, append=True)
        done, in_a_row = done + n, 0
        checkpoint(done)
    return {"done": done, "failed_batches": failed}
