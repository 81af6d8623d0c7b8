"""Queries on lineage, streams of events, migrations and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import content as C
from lakeloom.operators import lineage as L
from lakeloom.plans.registry import EDGES, FILES, V1, edges, files, query
from lakeloom.sources import connectors as K
from lakeloom.sources import fixtures as X
from lakeloom.streaming import rollups as R


def _reach(up: bool, start: str, depth: int = 3) -> str:
    near, far = ("sink_hash", "source_hash") if up else ("source_hash", "sink_hash")
    return f"WITH RECURSIVE {EDGES}, pairs AS (SELECT DISTINCT {near} AS n, {far} AS f FROM edges), r(node, depth) AS (SELECT '{start}', 0 UNION SELECT f, depth + 1 FROM r JOIN pairs ON n = node WHERE depth < {depth - 1}) SELECT id, kind, source_hash, sink_hash FROM edges WHERE {near} IN (SELECT node FROM r)"


@query(f"WITH {EDGES} SELECT id, ts, kind, source_hash, sink_hash, agent FROM edges WHERE sink_hash = 'u7'")
def lineage_parents(s, d):
    return L.parents(edges(s, d), "u7")


@query(f"WITH {EDGES} SELECT id, ts, kind, source_hash, sink_hash, agent FROM edges WHERE source_hash = 'u7'")
def lineage_children(s, d):
    return L.children(edges(s, d), "u7")


@query(_reach(True, "u50"))
def lineage_ancestors_d3(s, d):
    return L.reach(edges(s, d), "u50", 3, up=True).select("id", "kind", "source_hash", "sink_hash")


@query(_reach(False, "u7", 2))
def lineage_descendants_d2(s, d):
    return L.reach(edges(s, d), "u7", 2, up=False).select("id", "kind", "source_hash", "sink_hash")


_DAG = "dag AS (SELECT 'e1/'||n_nationkey AS id, 'r'||n_regionkey AS source_hash, 'n'||n_nationkey AS sink_hash FROM nation UNION ALL SELECT 'e2/'||c_custkey, 'n'||c_nationkey, 'c'||c_custkey FROM customer UNION ALL SELECT 'e3/'||o_orderkey, 'c'||o_custkey, 'o'||o_orderkey FROM orders)"


@query(f"WITH {_DAG}, a AS (SELECT * FROM dag WHERE source_hash = 'r1'), b AS (SELECT * FROM dag WHERE source_hash IN (SELECT sink_hash FROM a)), c AS (SELECT * FROM dag WHERE source_hash IN (SELECT sink_hash FROM b)) SELECT id, source_hash, sink_hash FROM a UNION ALL SELECT id, source_hash, sink_hash FROM b UNION ALL SELECT id, source_hash, sink_hash FROM c")
def lineage_descendants_d3(s, d):
    """All that comes of one region: its nations, their customers, their orders."""
    t = lambda n: X.table(s, d, n)
    edge = lambda df, k, a, b, x, y: df.select(F.concat(F.lit(f"e{k}/"), F.col(b).cast("string")).alias("id"), F.concat(F.lit(x), F.col(a).cast("string")).alias("source_hash"), F.concat(F.lit(y), F.col(b).cast("string")).alias("sink_hash"))
    dag = edge(t("nation"), 1, "n_regionkey", "n_nationkey", "r", "n").union(edge(t("customer"), 2, "c_nationkey", "c_custkey", "n", "c")).union(edge(t("orders"), 3, "o_custkey", "o_orderkey", "c", "o"))
    return L.reach(dag, "r1", 3, up=False)


@query(f"WITH {EDGES} SELECT sink_hash AS subject, string_agg(ts||':'||id||':'||kind||':'||source_hash||':'||agent, ',' ORDER BY ts, id) AS direct_parents FROM edges WHERE sink_hash = 'u7' GROUP BY 1")
def lineage_provenance(s, d):
    p = L.provenance(edges(s, d), "u7")
    shown = F.transform("direct_parents", lambda x: F.concat_ws(":", x["ts"].cast("string"), x["id"].cast("string"), x["kind"], x["source"], x["agent"]))
    return p.select("subject", F.array_join(shown, ",").alias("direct_parents"))


@query(f"WITH {EDGES} SELECT (SELECT count(*) FROM edges WHERE sink_hash = 'u7') AS parents, (SELECT count(*) FROM edges WHERE source_hash = 'u7') AS children, (SELECT count(*) FROM ({_reach(True, 'u7').replace('WITH RECURSIVE ' + EDGES + ', ', 'WITH RECURSIVE ')})) AS ancestors, (SELECT count(*) FROM ({_reach(False, 'u7').replace('WITH RECURSIVE ' + EDGES + ', ', 'WITH RECURSIVE ')})) AS descendants")
def lineage_show(s, d):
    e = edges(s, d)
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("parents", L.parents(e, "u7")), ("children", L.children(e, "u7")), ("ancestors", L.reach(e, "u7", 3, up=True)), ("descendants", L.reach(e, "u7", 3, up=False)))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])


@query(f"WITH {EDGES}, b AS (SELECT *, ts - ts % 3600000 AS bucket FROM edges), k AS (SELECT bucket, kind, count(*) AS n FROM b GROUP BY 1, 2), e AS (SELECT bucket, count(DISTINCT source_hash) AS sources, count(DISTINCT sink_hash) AS sinks FROM b GROUP BY 1) SELECT bucket, string_agg(kind||'='||n, ',' ORDER BY kind) AS kinds, any_value(sources) AS sources, any_value(sinks) AS sinks FROM k JOIN e USING (bucket) GROUP BY 1")
def lineage_rollup_1h(s, d):
    r = L.rollup(edges(s, d), 3_600_000)
    shown = F.transform(F.array_sort(F.map_entries("kinds")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return r.select("bucket", F.array_join(shown, ",").alias("kinds"), "sources", "sinks")


@query(f"WITH {EDGES} SELECT ts - ts % 3600000 AS bucket, count(*) AS total FROM edges GROUP BY 1")
def lineage_rollup_total(s, d):
    return L.rollup_total(L.rollup(edges(s, d), 3_600_000))


@query(f"WITH {EDGES} SELECT id, kind, source_hash FROM edges UNION ALL SELECT id + 10000000, 'derive', source_hash FROM edges WHERE kind = 'write'")
def lineage_append(s, d):
    """The whole journal, as lines of JSON, after edges are appended to it; a kind that is not given is derive."""
    e = edges(s, d)
    path = K.scratch(s, "journal")
    K.append_jsonl(e, path)
    new = e.filter("kind = 'write'").withColumns({"id": F.col("id") + 10_000_000, "kind": F.lit(None).cast("string")})
    K.append_jsonl(new.withColumn("kind", F.coalesce("kind", F.lit("derive"))), path)
    return K.read_jsonl(s, path, e.schema).select("id", "kind", "source_hash")


@query("SELECT event_type AS name, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def enum_parse(s, d):
    """Kinds of edges by name; what is no kind is null."""
    e = X.table(s, d, "events").withColumn("said", F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "write").otherwise(F.concat("event_type", F.lit("s"))))
    return e.groupBy(F.col("event_type").alias("name"), L.parse_kind(F.col("said")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT (epoch_us(date_trunc('hour', ts)) // 1000) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_rollup(s, d):
    """Events by hour and type, rolled up by a stream over their files."""
    events = X.table(s, d, "events").select("ts", "event_type")
    source, target = K.scratch(s, "events"), K.scratch(s, "rolled")
    events.repartition(4).write.parquet(source)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/{epoch}")
    q = R.stream_rollup(stream, late="90 days").writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", K.scratch(s, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("bucket long, event_type string, n long").parquet(f"{target}/{q.lastProgress['batchId']}")


_OBJECTS = f"{FILES}, {V1}, ob AS (SELECT path AS path, size, doc_id FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT '/moved'||path, size, doc_id FROM files), re AS (SELECT o.path, CASE WHEN o.path IN (SELECT path FROM v1) THEN 'skipped' WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'transferred' END AS outcome, size FROM ob o)"


def _transfers(s, d):
    f = files(s, d)
    o = f.filter("doc_id % 3 = 0").select("path", "size", "doc_id").union(f.select(F.concat(F.lit("/moved"), "path"), "size", "doc_id"))
    return C.transfer(o.select("path", "size", (F.col("doc_id") % 17 != 0).alias("readable")), f.select("path"))


@query(f"WITH {_OBJECTS} SELECT path, outcome, CASE WHEN outcome = 'transferred' THEN size ELSE 0 END AS bytes FROM re")
def migration_skip_existing(s, d):
    """Objects of which some are in the store already and some can't be read."""
    return _transfers(s, d).select("path", "outcome", "bytes")


@query(f"WITH {_OBJECTS} SELECT count(*) AS total, count(*) FILTER (outcome = 'transferred') AS transferred, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, CAST(sum(CASE WHEN outcome = 'transferred' THEN size ELSE 0 END) AS BIGINT) AS bytes, round((count(*) - count(*) FILTER (outcome = 'failed')) / count(*), 6) AS success_rate FROM re")
def migration_stats(s, d):
    return C.transfer_stats(_transfers(s, d))


@query("SELECT event_id, (epoch_us(ts) // 1000) + user_id * 3600000 > 1705000000000 AS valid, NOT ((epoch_us(ts) // 1000) + user_id * 3600000 > 1705000000000) AS purged FROM events")
def sessions_valid(s, d):
    """Sessions that last as many hours as their user's number: valid at a time, or to be purged then."""
    end = F.unix_millis(F.col("ts").cast("timestamp")) + F.col("user_id") * 3_600_000
    valid = F.lit(1_705_000_000_000) < end
    return X.table(s, d, "events").select("event_id", valid.alias("valid"), (~valid).alias("purged"))
