"""Command line: ``python -m tessera build|search|ask|smoke|serve --index FOLDER ...``.

Vectors are word hashes and answers are extracts, so that it runs without a model; give other callables to
``build_index``, ``retrieve`` and ``answering`` for more.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lexemes import plain_tokens
from tessera.functions.text import needs_loop
from tessera.functions.vectors import hashed_embedding
from tessera.operators import retrieval
from tessera.operators.chunking import chunk_pages
from tessera.operators.store import IndexStore
from tessera.plans import answering, build, service
from tessera.sources.snapshot import read_pages

DIMS = 256


def embed(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_key", hashed_embedding(F.col("text"), DIMS).alias("embedding"))


def asked(spark: SparkSession, question: str, library: str | None = None, kind: str | None = None) -> DataFrame:
    """A query table of one row."""
    row = spark.createDataFrame([("q", question, library, kind)], "query_id string, query string, library string, kind string")
    return row.withColumns({"vector": hashed_embedding(F.col("query"), DIMS), "query_lexemes": plain_tokens(F.col("query"))})


def tools(spark: SparkSession, chunks: DataFrame, k: int = 8) -> answering.Tools:
    def search(question: str, library: str | None, kind: str | None) -> list[dict]:
        return [r.asDict() for r in retrieval.search(chunks, asked(spark, question, library, kind), k).orderBy("rank").collect()]

    def read(url: str) -> dict | None:
        row = retrieval.stored_pages(chunks.where(F.col("url") == url)).first()
        return {"url": url, "anchor": "", "heading_path": row.page_title, "content": row.text} if row else None

    return answering.Tools(search, read)


def answer(spark: SparkSession, chunks: DataFrame, question: str, progress: answering.Progress = lambda line: None) -> str:
    loop = lambda q: spark.range(1).select(needs_loop(F.lit(q))).first()[0]
    found = answering.routed(question, tools(spark, chunks), lambda *a: "", answering.extractive, loop, progress)
    links = "\n".join(f"- [{c['title']}]({c['url']}#{c['anchor']})" for c in found.citations)
    return f"{found.answer_md}\n\n{links}" if links else found.answer_md or "Nothing was found."


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    parts = {name: commands.add_parser(name) for name in ("build", "search", "ask", "smoke", "serve")}
    for p in parts.values():
        p.add_argument("--index", required=True)
    parts["build"].add_argument("--snapshot", required=True)
    for name in ("search", "ask"):
        parts[name].add_argument("question")
    for flag in ("--library", "--kind"):
        parts["search"].add_argument(flag)
    parts["search"].add_argument("-k", type=int, default=8)
    parts["serve"].add_argument("--port", type=int, default=8080)
    given = parser.parse_args(arguments)
    spark = spark or session()
    store = IndexStore(spark, given.index, DIMS)
    if given.command == "build":
        units = chunk_pages(read_pages(spark, given.snapshot))
        stamp = build.recipe("1", f"hash-{DIMS}", "none", "none")
        print(build.build_index(store, units, embed, plain_tokens, f"crawl-{datetime.now(UTC):%Y%m%d-%H%M}", stamp))
    elif given.command == "search":
        for r in retrieval.search(store.chunks(), asked(spark, given.question, given.library, given.kind), given.k).orderBy("rank").collect():
            print(f"{r['rank']}. {r.title}  {r.url}#{r.anchor}")
    elif given.command == "ask":
        print(answer(spark, store.chunks(), given.question, lambda line: print(f"  {line}", file=sys.stderr)))
    elif given.command == "smoke":
        found = probes(spark, store)
        print("\n".join(f"{name}: {state}" for name, state in found.items()))
        return int(any(state != "ok" for state in found.values()))
    else:
        chunks = store.chunks().cache()
        served = service.Service(lambda q, progress: answer(spark, chunks, q, progress))
        served.warm_up()
        service.http_server(served, port=given.port, health=lambda: probes(spark, store)).serve_forever()
    return 0


def probes(spark: SparkSession, store: IndexStore) -> dict[str, str]:
    """Can the store be written and read, has it chunks, do vectors have the width that it holds?"""
    width = lambda: asked(spark, "a probe").select(F.size("vector")).first()[0] == DIMS
    return service.probes(store=store.probe, chunks=lambda: bool(store.chunks().head(1)), embedding=width)


if __name__ == "__main__":
    sys.exit(main())
