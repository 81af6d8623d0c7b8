"""Queries on stores, branches, logs, binary formats and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import content as C
from lakeloom.operators import governance as G
from lakeloom.plans.registry import CHUNKS, COMMITS, EDGES, FILES, _redact_sql, docs, edges, files, query
from lakeloom.sources import connectors as K
from lakeloom.sources import fixtures as X
from lakeloom.streaming import rollups as R


# Lines of JSON, logs -------------------------------------------------------------------------------------------------
@query(f"WITH {EDGES} SELECT id, ts, kind, source_hash, sink_hash FROM edges WHERE id % 10 <> 0")
def jsonl_scan_tolerant(s, d):
    """Edges written as lines, each tenth one broken or blank, and read back."""
    line = F.when(F.col("id") % 20 == 0, "").when(F.col("id") % 10 == 0, '{"id": 1, "ts"').otherwise(F.to_json(F.struct("id", "ts", "kind", "source_hash", "sink_hash")))
    path = K.scratch(s, "journal")
    edges(s, d).select(line.alias("value")).write.text(path)
    return K.read_jsonl(s, path, "id long, ts long, kind string, source_hash string, sink_hash string")


# Stores and versions -------------------------------------------------------------------------------------------------
@query(f"WITH {FILES}, {CHUNKS}, h AS (SELECT DISTINCT path, sha256(data) AS hash FROM chunks) SELECT DISTINCT hash FROM h WHERE hash NOT IN (SELECT h.hash FROM h JOIN files ON h.path = files.path WHERE doc_id % 50 = 0)")
def chunk_delete(s, d):
    f = files(s, d)
    stored = X.chunks(f).select("hash").distinct()
    return C.delete_chunks(stored, X.chunks(f.filter("doc_id % 50 = 0")).select("hash"))


@query(f"WITH {COMMITS}, h AS (SELECT author, arg_max(hash, (ts, hash)) AS head, max(ts) AS ts FROM commits WHERE author % 100 = 1 GROUP BY 1) SELECT hash, parent, author, ts FROM commits UNION ALL SELECT -head, head, author, ts + 1 FROM h")
def commit_append(s, d):
    c = X.commits(X.table(s, d, "orders"))
    heads = c.filter("author % 100 = 1").groupBy("author").agg(F.max_by("hash", F.struct("ts", "hash")).alias("head"), (F.max("ts") + 1).alias("ts"))
    return C.commit(c, heads.withColumn("hash", -F.col("head")))


@query("SELECT * FROM (VALUES ('create', 'b1', 'exists'), ('create', 'new', 'ok'), ('delete', 'b2', 'ok'), ('delete', 'b1', 'current'), ('delete', 'none', 'missing')) t(op, name, result)")
def branch_ops(s, d):
    b = X.table(s, d, "customer").select(F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("name"))
    ops = s.createDataFrame([("create", "b1"), ("create", "new"), ("delete", "b2"), ("delete", "b1"), ("delete", "none")], "op string, name string")
    return C.branch_results(b, ops, "b1")


@query(f"WITH {COMMITS} SELECT 'b'||author AS name, arg_max(hash, (ts, hash)) AS head FROM commits GROUP BY author UNION ALL SELECT 'v1', 5")
def version_tag(s, d):
    """Branches, with a tag: a branch at a given commit."""
    heads = X.commits(X.table(s, d, "orders")).groupBy(F.concat(F.lit("b"), F.col("author").cast("string")).alias("name")).agg(F.max_by("hash", F.struct("ts", "hash")).alias("head"))
    return heads.unionByName(s.createDataFrame([("v1", 5)], "name string, head long"))


@query("SELECT '/' AS path, 'dir' AS kind, sha256('') AS hash, 'main' AS branch")
def store_init(s, d):
    return C.empty_store(s)


@query(f"WITH {FILES} SELECT path, hash FROM files UNION ALL SELECT '/agents/a1'||substring(path, 6), hash FROM files WHERE starts_with(path, '/src3/')")
def agent_fork(s, d):
    return C.fork(files(s, d).select("path", "hash"), "/src3", "/agents/a1")


@query(f"WITH {FILES} SELECT path, doc_id||'.txt' AS name, substring(hash, 1, 12) AS short, 'binary' AS type FROM files")
def explorer_columns(s, d):
    return files(s, d).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.substring("hash", 1, 12).alias("short"), T.content_type(F.col("path")).alias("type"))


_WORKLOADS = [("sequential", 4, 0, 0), ("random-read", 2, 10, 0), ("write-heavy", 3, 0, 0), ("mixed", 0, 0, 50), ("metadata-storm", 0, 1000, 0), ("checkpoint-delta", 10, 0, 7)]


@query("SELECT * FROM (VALUES ('sequential', 4194304), ('random-read', 20971520), ('write-heavy', 3145728), ('mixed', 536870912), ('metadata-storm', 256000), ('checkpoint-delta', 734003)) t(kind, bytes)")
def workload_bytes(s, d):
    w = s.createDataFrame(_WORKLOADS, "kind string, size long, count long, percent long")
    return w.select("kind", G.workload_bytes(*map(F.col, w.columns)).alias("bytes"))


@query("SELECT c_custkey AS tenant, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE round(count(o_orderkey) / 12, 6) END AS fraction FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def quota_fraction(s, d):
    used = X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg(F.count("*").alias("used"))
    t = X.table(s, d, "customer").select(F.col("c_custkey").alias("tenant")).join(used, "tenant", "left")
    most = F.when(F.col("tenant") % 7 == 0, 0).otherwise(12)
    return t.select("tenant", F.round(G.bytes_fraction(F.coalesce("used", F.lit(0)), most), 6).alias("fraction"))


# Text of files -------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, sha256({_redact_sql('(text||chr(65533))')}) AS text FROM documents")
def read_text_redacted(s, d):
    """Texts with a byte that is no UTF-8 at the end, read and redacted."""
    content = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    return docs(s, d).select("doc_id", F.sha2(G.redact(T.utf8(content)), 256).alias("text"))


@query("SELECT event_id, 'k k '||event_type AS strings FROM events")
def extract_jsonl(s, d):
    lines = F.concat_ws("\n", "props", F.lit("no json"), F.to_json(F.struct(F.col("event_type").alias("k"))))
    return X.table(s, d, "events").select("event_id", T.extract_json_lines(lines).alias("strings"))


# Sources and streams -------------------------------------------------------------------------------------------------
@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings'])||'.parquet' AS name, true AS filled")
def source_list_limited(s, d):
    """The first five tables of the folder, in the order of their names. A table is a file, or a folder of files."""
    return K.list_files(s, d, 5, folders=True).select("name", (F.col("size") > 0).alias("filled"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(s, d):
    """Each user's last event, kept by a stream over the events."""
    events = X.table(s, d, "events").select("user_id", "event_id")
    source, target = K.scratch(s, "events"), K.scratch(s, "users")
    events.write.parquet(source)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(source)
    q = stream.writeStream.foreachBatch(R.upsert_into(target, "user_id", "event_id")).option("checkpointLocation", K.scratch(s, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return R.read_upserted(s, target, events.schema)
