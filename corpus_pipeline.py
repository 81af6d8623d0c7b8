"""A corpus pipeline of five operators: language ID, near-duplicates, repeated passages, source mixing, packing.

run(spark, sf_dir) applies STAGES to the documents of a folder of tables. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import cdc, langid, minmax, mixing, packing
from lakeloom.llm.queries import END_ID, vocabulary
from lakeloom.llm.runtime import empty_scratch, materialize, scratch_mark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learnt language is found; those without any letter go."""
    return langid.identify(docs, whole_rows=True).filter("_lang_pred <> 'und'").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id: five-word shingles, similarity 0.8.

    Rows with one doc_id, or with none, are told apart by numbers in the order of doc_id, null last."""
    ids = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if ids.isEmpty():
        rows, key = docs, "doc_id"
    else:
        order, key = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")], "_row"
        rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id())
        rows = materialize(rows, "numbered rows")
    named = rows.select(F.col(key).alias("doc_id"), "text")
    gone = minmax.near_duplicates(named, words=5, percent=80, bands=30, rows=5).filter("not kept").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    out = cdc.remove_repeats(docs).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, repeats included."""
    return mixing.mixed_rows(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), END_ID, 1024)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: Language models, signatures and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents. Once a stage's result is written, what it and the stages before it had written goes."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage {name}")
        empty_scratch(spark, mark, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
