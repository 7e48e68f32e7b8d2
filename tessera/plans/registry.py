"""Where queries and their SQL are registered, and the tables that several of them start from.

The chunk table is ``documents`` joined with ``embeddings`` by id: the label gives the kind, the source
the library.  Search queries are the embeddings whose id is divisible by 50; a query's text is the two
longest words of its document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import KINDS
from tessera.functions.lexemes import plain_tokens
from tessera.streaming.runs import folder

__all__ = ["ORACLE_SQL", "QUERIES", "chunk_table", "folder", "query", "query_table", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunk_table(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    """With ``how`` left, documents without a vector too: a null vector, and the last kind."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    rows = docs.join(table(spark, sf, "embeddings"), docs.doc_id == F.col("vec_id"), how)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.coalesce(F.col("label") % 3, F.lit(2)) + 1)
    url = F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html"))
    return rows.select(
        F.format_string("%012d", "doc_id").alias("chunk_key"), url.alias("url"), F.lit("").alias("anchor"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("page_title"),
        F.concat(F.lit("Section "), "source").alias("heading_path"), F.col("source").alias("library"), kind.alias("kind"), F.lit(0).alias("part"), "embedding", plain_tokens(F.col("text")).alias("lexemes"), F.col("text").alias("content"),
    )


def query_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").where("doc_id % 50 = 0")  # first, or conditions on the words make those of every document
    asked = table(spark, sf, "embeddings").where("vec_id % 50 = 0").join(docs, F.col("vec_id") == F.col("doc_id"))
    longer = lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    words = F.slice(F.array_sort(F.array_distinct(plain_tokens(F.col("text"))), longer), 1, 2)
    return asked.select(F.format_string("%012d", "vec_id").alias("query_id"), F.array_join(words, " ").alias("query"), words.alias("query_lexemes"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("library"), F.lit(None).cast("string").alias("kind"))
