"""Queries of this subpackage, by the contracts' parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import cdc, digest, embjoin, fst_tokens, html_extract, langid, minmax, mixing, packing, pfor

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; it is the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, F.col("size"))
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = pfor.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)
    return pfor.read_token_files(spark, folder)


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embjoin.link_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op6_minmax_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, bands=24, rows=5)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID, 1024)


def op8_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its cleaned text, where it was cut, and the documents that keep what it loses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cdc.remove_repeats(docs)
    return out.select("doc_id", F.col("_first_ids").alias("first_doc_ids"), F.col("_n_removed").alias("n_removed"), F.col("_spans").alias("spans"), "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_language_mixture, op3_token_files, op4_embedding_links, op5_main_text, op6_minmax_duplicates, op7_best_fit_packing, op8_substring_repeats, op9_token_counts, op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    """None yet: the mix hangs on Spark's hash, and the others need tokenizers, models or graph algorithms. They are
    tested against brute force in tests/llm."""
    return {}
