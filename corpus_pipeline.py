"""A training corpus from raw documents, in five stages of one operator each.

Each stage takes all documents that its predecessor kept and returns the columns of ``documents``,
with the text as it is after the stage's decisions; the last one returns packed pieces.  ``run``
applies them in order; between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.crf import UNDETERMINED, fit, identify, labelled_sample, learned_rows
from tessera.llm.lines import remove_boilerplate
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.substrings import remove_repeats
from tessera.llm.tokens import default_tokenizer
from tessera.llm.workspace import Workspace, scratch
from tessera.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose words' largest marginals have a smaller mean is no running text of learned languages.
LEAST_SCORE = 0.5


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The columns of documents from ``row``, with another text and its length."""
    own = {"text": F.col(text), "n_chars": F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long")}
    return rows.select(*[own.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those without a letter (null texts too), and those of no learned language.

    A text in several languages stays if its words' labels are sure.  Null keys and repeated rows are
    judged by their texts like all others.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    _, rows = learned_rows(docs)
    model = fit(labelled_sample(rows, "lang", "text", "doc_id"))
    kept = identify(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= LEAST_SCORE))
    return kept.select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources carry go from every document; the document stays, also one that is null or
    becomes empty.  Null keys and repeated rows are documents of their own."""
    ship(spark)
    return _with_text(remove_boilerplate(docs.select(*COLUMNS), Workspace(spark, "lines")), "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Empty and null texts and rows with a null id are in no group and stay; all rows of an id go or stay
    together.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs.select("doc_id", "text"), Workspace(spark, "near"), k=5, percent=80)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows go; a text that loses nothing keeps its layout, a null one stays null.

    Repeated rows are places of their own, so their windows repeat; null keys too.
    """
    ship(spark)
    return _with_text(remove_repeats(docs.select(*COLUMNS), width=35, layout=True), "kept")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2,048-token sequences; a null or empty text is one piece of the end id, repeated rows and
    null keys are documents of their own."""
    ship(spark)
    return pack(docs.select("doc_id", "text"), Workspace(spark, "pack"), default_tokenizer(), end_id=1, window=2048, literal=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Learned language labels, word-set similarity closures and least-squares packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written and read again,
    and what a stage wrote besides goes with it, like the documents that it read."""
    space = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = space.save(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
