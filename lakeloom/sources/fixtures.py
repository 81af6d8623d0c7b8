"""Tables of the data model, derived from the star schema, events, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types as the five kinds of lineage edges.
EDGE_KINDS = {"view": "read", "click": "write", "purchase": "derive", "signup": "copy", "error": "transform"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(docs: DataFrame) -> DataFrame:
    """path, hash, size, lang, source, doc_id, text of each document as a file."""
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"), "lang", "source", "doc_id", "text")


def edges(events: DataFrame) -> DataFrame:
    """id, ts (ms), kind, source_hash, sink_hash, agent: users' events as lineage, sinks being folded to 97 artefacts."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_KINDS.items() for x in kv]), F.col("event_type"))
    return events.select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("source_hash"), F.concat(F.lit("u"), (F.col("event_id") % 97).cast("string")).alias("sink_hash"), F.col("event_type").alias("agent"))


def vectors(embeddings: DataFrame) -> DataFrame:
    """file_hash, embedding, label, model_version, stale."""
    return embeddings.select(F.sha2(F.col("vec_id").cast("string"), 256).alias("file_hash"), "vec_id", "embedding", "label", F.when(F.col("label") % 2 == 0, "m-v1").otherwise("m-v2").alias("model_version"), F.lit(False).alias("stale"))


def commits(orders: DataFrame) -> DataFrame:
    """hash, parent, author, ts: each customer's orders by date as a first-parent chain."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("hash"), F.lag("o_orderkey").over(w).alias("parent"), F.col("o_custkey").alias("author"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"))


def history(orders: DataFrame) -> DataFrame:
    """hash, parents, author, email, ts, tree, message: each customer's orders by date as commits; some have a second parent,
    the next customer's first one."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = orders.select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("c"), F.lag("o_orderkey").over(w).alias("before"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    first = orders.groupBy((F.col("o_custkey") - 1).alias("c")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("merged"))
    second = F.when(F.col("hash") % 10 == 0, F.col("merged"))
    parents = F.when(F.col("before").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_compact(F.array("before", second)))
    author = F.concat(F.lit("u"), F.col("c").cast("string"))
    said = F.concat(F.lit("order "), F.col("hash").cast("string"))
    return o.join(first, "c", "left").select("hash", parents.alias("parents"), author.alias("author"), F.concat(author, F.lit("@example.com")).alias("email"), "ts", F.sha2(F.concat(F.lit("t"), F.col("hash").cast("string")), 256).alias("tree"), said.alias("message"))


#: Bytes of a chunk in these tables, small so that documents have several.
CHUNK = 4096


def chunks(fs: DataFrame, size: int = CHUNK) -> DataFrame:
    """path, pos, hash, length, data: fixed windows of each file's bytes."""
    from lakeloom.operators.store import chunk_rows

    return chunk_rows(fs.select("path", F.col("text").cast("binary").alias("data")), size)
