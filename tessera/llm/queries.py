"""The registered queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import hamming, importance, lines, minhash, phrases, substrings, variants, warc
from tessera.llm.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.crf import fit, identify, labelled_sample, learned_rows

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held, rows = learned_rows(docs)
    model = fit(labelled_sample(rows, "lang", "text", "doc_id"))
    found = identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=("doc_id", "held_out"))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pieces import default_model, nbest_segmentations

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = nbest_segmentations(docs, default_model(), n=3, decode=True)
    return found.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substrings import remove_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, width=35).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack
    from tessera.llm.tokens import default_tokenizer

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pack(docs, Workspace(spark, "op5"), default_tokenizer(), end_id=1, window=2048, literal=False)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import read_archives, write_archives

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = read_archives(write_archives(pages, Workspace(spark, "op6"), min_revisit_bytes=0), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import near_duplicates

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Workspace(spark, "op7"), k=3, percent=85)


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hamming import sign_codes, top_k

    codes = sign_codes(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(codes, codes.where("vec_id % 50 = 0"), Workspace(spark, "op8"), k=10)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lines import remove_boilerplate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = remove_boilerplate(docs, Workspace(spark, "op9"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.huffman import read_tokens, write_tokens
    from tessera.llm.tokens import default_tokenizer, tokenize

    space = Workspace(spark, "op10")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = space.save(tokenize(docs, default_tokenizer(), end_id=0, literal=False), "tokens")
    path = write_tokens(tokens, space)
    space.drop("tokens")
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text")
    found = importance.resample(docs, target, Workspace(spark, "op11"))
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = phrases.contamination(docs, items, Workspace(spark, "op12"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.spelling_variants(variants.word_counts(docs, every=variants.EVERY), Workspace(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_nbest_pieces": op2_nbest_pieces,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_near_dedup": op7_near_dedup,
    "op8_hamming_top_k": op8_hamming_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
    "op11_importance": op11_importance,
    "op12_decontamination": op12_decontamination,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": substrings.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_near_dedup": minhash.ORACLE,
    "op8_hamming_top_k": hamming.ORACLE,
    "op9_line_dedup": lines.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_decontamination": phrases.ORACLE,
    "op13_spelling_variants": variants.ORACLE,
}
