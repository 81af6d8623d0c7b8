"""Ingest of files into the index: text, policy, embedding; and embedding anew of what an older model made.

An embedder is a function from a list of texts to a list of vectors, or None for a text that it fails on. It runs on
batches in Python workers; any model that workers can load may stand behind it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import governance as G

Embedder = Callable[[list[str]], list[list[float] | None]]
Filter = Callable[[Column], Column]
#: Texts that an embedder gets at once.
BATCH = 32
#: Components of the plain embedder's vectors.
DIMENSIONS = 4
_WORD = re.compile(r"[^\W_]+")


def allow_all() -> Filter:
    """Every document passes."""
    return lambda xattrs: xattrs.isNotNull() | xattrs.isNull()


def deny_list(*pairs: tuple[str, str]) -> Filter:
    """Documents pass whose attributes have none of the pairs."""

    def allow(xattrs: Column) -> Column:
        hit = F.lit(False)
        for k, v in pairs:
            hit = hit | F.coalesce(xattrs[k] == v, F.lit(False))
        return ~hit

    return allow


def length_counts(texts: list[str]) -> list[list[float] | None]:
    """A plain embedder: how many words have each length, modulo DIMENSIONS. It fails on texts whose length thirteen divides."""
    out: list[list[float] | None] = []
    for t in texts:
        v = [0.0] * DIMENSIONS
        for w in _WORD.findall(t):
            v[len(w) % DIMENSIONS] += 1
        out.append(v if len(t) % 13 else None)
    return out


def embed(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """rows (text, and others) with embedding: null where the embedder fails, on one text or on a whole batch."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [x or "" for x in batch.column("text").to_pylist()], []
            for k in range(0, len(texts), BATCH):
                part = texts[k : k + BATCH]
                try:
                    found += embedder(part)
                except Exception:  # an embedder may fail in any way; its texts are stored without a vector
                    found += [None] * len(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", embedding array<float>")


def ingest(files: DataFrame, allow: Filter, embed: Embedder | None = None, model: str = "", redact: bool = False) -> DataFrame:
    """files (path, content, xattrs, and others) as documents: text, embedding and model_version in place of content. Files that
    the filter keeps out are not read further. Without an embedder, and where it fails, embedding is empty and model_version
    blank."""
    text = T.extract_text(F.col("path"), F.col("content"))
    rows = files.filter(allow(F.col("xattrs"))).withColumn("text", G.redact(text) if redact else text).drop("content")
    rows = rows.withColumn("embedding", F.lit(None).cast("array<float>")) if embed is None else globals()["embed"](rows, embed)
    done = F.col("embedding").isNotNull()
    return rows.withColumns({"model_version": F.when(done, model).otherwise(""), "embedding": F.coalesce("embedding", F.array().cast("array<float>"))})


def reembed(vectors: DataFrame, texts: DataFrame, embedder: Embedder | None, model: str) -> DataFrame:
    """vectors (vec_id, embedding, model_version, stale, and others) with result: kept, done (made anew from the text (vec_id,
    text)), or failed: no text, no embedder, or one that fails; these stay as they are and stale."""
    fresh = vectors.filter(~F.col("stale")).withColumn("result", F.lit("kept"))
    old = vectors.filter("stale").withColumnRenamed("embedding", "before").join(texts, "vec_id", "left")
    new = embed(old, embedder) if embedder else old.withColumn("embedding", F.lit(None).cast("array<float>"))
    done = F.col("text").isNotNull() & F.col("embedding").isNotNull()
    new = new.withColumns({"result": F.when(done, "done").otherwise("failed"), "model_version": F.when(done, model).otherwise(F.col("model_version")), "stale": ~done, "embedding": F.when(done, F.col("embedding")).otherwise(F.col("before"))})
    return fresh.unionByName(new.select(*fresh.columns))


def reembed_report(found: DataFrame) -> DataFrame:
    result = F.col("result")
    return found.agg(F.count_if(result != "kept").alias("stale_found"), F.count_if(result == "done").alias("reembedded"), F.count_if(result == "failed").alias("failed"))
