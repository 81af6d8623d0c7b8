"""All queries by name, each a composition of operators, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import content as C
from lakeloom.operators import governance as G
from lakeloom.operators import lineage as L
from lakeloom.operators import search as S
from lakeloom.sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The same fixtures in SQL.
FILES = "files AS (SELECT '/'||source||'/'||lang||'/'||doc_id||'.txt' AS path, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size, lang, source, doc_id, text FROM documents)"
EDGES = "edges AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'derive' WHEN 'signup' THEN 'copy' WHEN 'error' THEN 'transform' END AS kind, 'u'||(user_id % 40) AS source_hash, 'u'||(event_id % 97) AS sink_hash, event_type AS agent FROM events)"
VECTORS = "vectors AS (SELECT sha256(CAST(vec_id AS VARCHAR)) AS file_hash, vec_id, embedding, label, CASE WHEN label % 2 = 0 THEN 'm-v1' ELSE 'm-v2' END AS model_version, false AS stale FROM embeddings)"
V1 = "v1 AS (SELECT path, hash FROM files)"
COMMITS = "commits AS (SELECT o_orderkey AS hash, lag(o_orderkey) OVER w AS parent, o_custkey AS author, (epoch_us(o_orderdate) // 1000) AS ts FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
CHUNKS = "fx AS (SELECT path, hex(encode(text)) AS hx FROM files), chunks AS (SELECT path, CAST(i AS INTEGER) AS pos, unhex(substr(hx, CAST(i * 8192 + 1 AS BIGINT), 8192)) AS data FROM fx, unnest(range(0, CAST(ceil(length(hx) / 8192.0) AS BIGINT))) u(i))"
TENANTS = "t AS (SELECT c_custkey AS tenant, CAST(sum(o_totalprice) AS BIGINT) AS used, count(*) AS running FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """Let the modules that import this one register their queries."""
    from lakeloom.plans import control, graphs, searches, service, stores, texts, versions  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def docs(s, d):
    return X.table(s, d, "documents")


def files(s, d):
    return X.files(docs(s, d))


def edges(s, d):
    return X.edges(X.table(s, d, "events"))


def vectors(s, d):
    return X.vectors(X.table(s, d, "embeddings"))


# Search -------------------------------------------------------------------------------------------------------------
def _query_vector(v: DataFrame) -> DataFrame:
    return v.filter("vec_id = 0").select(F.col("embedding").alias("q"))


def _cos(where: str = "true", limit: int = 10) -> str:
    return f"SELECT vec_id, score FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE {where}) ORDER BY score DESC, vec_id LIMIT {limit}"


@query(_cos())
def vector_topk(s, d):
    v = vectors(s, d)
    return S.vector_topk(v, _query_vector(v), 10).select("vec_id", "score")


@query(_cos("len(embedding) = 64 AND vec_id <> 0", 20))
def vector_similar(s, d):
    v = vectors(s, d)
    return S.vector_topk(v.filter("vec_id <> 0"), _query_vector(v), 20).select("vec_id", "score")


@query(_cos("label = 3"))
def vector_by_label_filter(s, d):
    v = vectors(s, d)
    return S.vector_topk(v.filter("label = 3"), _query_vector(v), 10).select("vec_id", "score")


@query(f"WITH {VECTORS} SELECT count(*) FILTER (model_version <> 'm-v2') AS newly_stale, count(*) AS n FROM vectors")
def mark_stale(s, d):
    return S.mark_stale(vectors(s, d), "m-v2").agg(F.count_if("stale").alias("newly_stale"), F.count("*").alias("n"))


@query(f"WITH {VECTORS} SELECT file_hash, model_version FROM vectors WHERE model_version <> 'm-v2'")
def list_stale(s, d):
    return S.mark_stale(vectors(s, d), "m-v2").filter("stale").select("file_hash", "model_version")


@query(f"WITH {VECTORS} SELECT file_hash, CASE WHEN vec_id % 10 = 0 THEN 'm-v3' ELSE model_version END AS model_version FROM vectors")
def vector_upsert(s, d):
    v = vectors(s, d).select("file_hash", "vec_id", "model_version")
    return S.upsert(v, v.filter("vec_id % 10 = 0").withColumn("model_version", F.lit("m-v3")), "file_hash").select("file_hash", "model_version")


# Lineage ------------------------------------------------------------------------------------------------------------
@query(f"WITH {EDGES} SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM edges")
def lineage_ts_bounds(s, d):
    return edges(s, d).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {EDGES} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM edges) WHERE r % 1000 < 125")
def lineage_sampled(s, d):
    return L.sampled(edges(s, d).select("id"), 0.125)


@query(f"WITH {EDGES} SELECT id, kind FROM edges WHERE source_hash <> sink_hash AND source_hash <> 'u0' AND sink_hash <> 'u0'")
def lineage_record_valid(s, d):
    return L.valid(edges(s, d)).select("id", "kind")


# Content and files --------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def chunk_put_new(s, d):
    f = files(s, d).select("doc_id", "hash")
    return C.put_new(f.filter("doc_id % 2 = 0"), f.filter("doc_id % 2 = 1")).select("hash")


@query(f"WITH {FILES} SELECT CASE WHEN starts_with(path, '/src2/') THEN '/moved'||substring(path, 6) ELSE path END AS path, hash FROM files")
def fs_rename(s, d):
    return C.rename(files(s, d).select("path", "hash"), "/src2", "/moved")


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT starts_with(path, '/src2/')")
def fs_delete_recursive(s, d):
    return files(s, d).filter(~C.under(F.col("path"), "/src2")).select("path")


@query(f"WITH {FILES} SELECT path, hash FROM files UNION ALL SELECT '/fork'||substring(path, 6), hash FROM files WHERE starts_with(path, '/src2/')")
def fs_fork(s, d):
    return C.fork(files(s, d).select("path", "hash"), "/src2", "/fork")


PATHS = "('/a//b/'), ('\\a\\b'), ('a/b'), ('/a/../b'), ('/'), ('/a/./b'), ('/x/y.z')"


@query(f"SELECT p AS raw, CASE WHEN NOT starts_with(n, '/') OR regexp_matches(n, '(^|/)\\.{{1,2}}(/|$)') THEN NULL ELSE n END AS path FROM (SELECT p, CASE WHEN q = '/' THEN q ELSE regexp_replace(q, '/$', '') END AS n FROM (SELECT p, regexp_replace(replace(p, '\\', '/'), '/+', '/', 'g') AS q FROM (VALUES {PATHS}) t(p)))")
def path_normalize(s, d):
    p = s.createDataFrame([("/a//b/",), ("\\a\\b",), ("a/b",), ("/a/../b",), ("/",), ("/a/./b",), ("/x/y.z",)], "raw string")
    return p.select("raw", C.normal_path(F.col("raw")).alias("path"))


# Versions -----------------------------------------------------------------------------------------------------------
@query(f"WITH {COMMITS}, w AS (SELECT * FROM (VALUES ('5'), ('b7'), ('nope')) t(name)), b AS (SELECT 'b'||author AS name, max(hash) AS hash FROM commits GROUP BY 1) SELECT w.name, coalesce(c.hash, b.hash) AS hash FROM w LEFT JOIN commits c ON CAST(c.hash AS VARCHAR) = w.name LEFT JOIN b ON b.name = w.name")
def commitish_resolve(s, d):
    c = X.commits(X.table(s, d, "orders"))
    w = F.broadcast(s.createDataFrame([("5",), ("b7",), ("nope",)], "name string"))
    by_hash = c.select(F.col("hash").cast("string").alias("name"), F.col("hash").alias("h")).join(w, "name", "left_semi")
    by_name = c.groupBy(F.concat(F.lit("b"), F.col("author").cast("string")).alias("name")).agg(F.max("hash").alias("b")).join(w, "name", "left_semi")
    return w.join(by_hash, "name", "left").join(by_name, "name", "left").select("name", F.coalesce("h", "b").alias("hash"))


# Reachability -------------------------------------------------------------------------------------------------------
@query(f"WITH {FILES} SELECT hash, greatest(0, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT)) AS refs FROM files GROUP BY 1")
def gc_refcount_delta(s, d):
    delta = F.when(F.col("doc_id") % 3 == 0, -1).otherwise(1).cast("long")
    return files(s, d).groupBy("hash").agg(F.greatest(F.lit(0).cast("long"), F.sum(delta)).alias("refs"))


# Governance ---------------------------------------------------------------------------------------------------------
TOKENS = [(1, "alice", "/src1", ["read"], 1000), (2, "bob", "/src2", ["read", "write"], 5000), (3, "eve", "/", ["list"], 4970)]
TOKENS_SQL = "tk AS (SELECT * FROM (VALUES (1, 'alice', '/src1', ['read'], 1000), (2, 'bob', '/src2', ['read', 'write'], 5000), (3, 'eve', '/', ['list'], 4970)) t(id, principal, scope, permissions, expires_at))"


def _tokens(s):
    return s.createDataFrame(TOKENS, "id int, principal string, scope string, permissions array<string>, expires_at int")


@query(f"WITH {FILES}, {TOKENS_SQL} SELECT id, count(*) AS covered FROM tk JOIN files ON starts_with(path, scope) WHERE list_contains(permissions, 'read') GROUP BY 1")
def token_covers(s, d):
    t = F.broadcast(_tokens(s))
    return files(s, d).select("path").join(t, F.col("path").startswith(F.col("scope")) & F.array_contains("permissions", "read")).groupBy("id").agg(F.count("*").alias("covered"))


def _redact_sql(col: str) -> str:
    for pattern, by in G.PII:
        col = f"regexp_replace({col}, '{pattern}', '{by}', 'g')"
    return col


@query(f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted FROM documents")
def redact_documents(s, d):
    return docs(s, d).select("doc_id", F.sha2(G.redact(F.col("text")), 256).alias("redacted"))


_HAS = " OR ".join(f"regexp_matches(text, '{p}')" for p, _ in G.PII)


@query(f"SELECT doc_id FROM documents WHERE {_HAS}")
def pii_detect(s, d):
    return docs(s, d).filter(G.has_pii(F.col("text"))).select("doc_id")


@query("SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS n{i}" for i, (p, _) in enumerate(G.PII)) + " FROM documents")
def pii_counts(s, d):
    return docs(s, d).agg(*[F.count_if(F.col("text").rlike(p)).alias(f"n{i}") for i, (p, _) in enumerate(G.PII)])


@query(f"SELECT count(*) AS checked, count(*) FILTER ({_HAS}) AS with_pii FROM documents")
def redact_check(s, d):
    return docs(s, d).agg(F.count("*").alias("checked"), F.count_if(G.has_pii(F.col("text"))).alias("with_pii"))


@query("WITH t AS (SELECT c_custkey AS tenant, count(o_orderkey) AS used FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1), q AS (SELECT tenant, used, CASE WHEN tenant % 7 = 0 THEN 0 ELSE 12 END AS most FROM t) SELECT tenant, CASE WHEN tenant % 11 = 0 THEN 'deny' WHEN most = 0 THEN 'allow' WHEN used + 1 > most THEN 'deny' WHEN used / most >= 0.9 THEN 'throttle' ELSE 'allow' END AS decision FROM q")
def quota_write_check(s, d):
    used = X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("used"))
    q = X.table(s, d, "customer").select("c_custkey").join(used, "c_custkey", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    most = F.when(F.col("c_custkey") % 7 == 0, 0).otherwise(12)
    return q.select(F.col("c_custkey").alias("tenant"), G.quota_decision(F.col("used") + 1, F.col("used"), most, F.col("c_custkey") % 11 != 0).alias("decision"))


@query("WITH t AS (SELECT c_custkey AS tenant, count(o_orderkey) AS running FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT tenant, CASE WHEN running >= 10 THEN 'deny' ELSE 'allow' END AS decision FROM t")
def quota_concurrency(s, d):
    t = X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg(F.count("*").alias("running"))
    t = X.table(s, d, "customer").select(F.col("c_custkey").alias("tenant")).join(t, "tenant", "left")
    return t.select("tenant", F.when(F.coalesce("running", F.lit(0)) >= 10, "deny").otherwise("allow").alias("decision"))


# Operations ---------------------------------------------------------------------------------------------------------
@query("SELECT CAST(i AS INTEGER) AS idx FROM (VALUES (0, 0), (1, 3600), (2, 691200), (3, 604800), (4, 604801)) t(i, age) WHERE age > 604800")
def retention_prune(s, d):
    ages = s.createDataFrame([([0, 3600, 691200, 604800, 604801],)], "ages array<int>")
    return ages.select(F.posexplode("ages").alias("idx", "age")).filter("age > 604800").select("idx")


@query("SELECT user_id, count(*) FILTER ((epoch_us(ts) // 1000) > 1705000000000) AS active FROM events GROUP BY 1")
def sessions_active(s, d):
    return X.table(s, d, "events").groupBy("user_id").agg(F.count_if(F.unix_millis(F.col("ts").cast("timestamp")) > 1_705_000_000_000).alias("active"))


# Text ---------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, sha256(array_to_string([trim(x, ' ') FOR x IN regexp_split_to_array(text, '[,\\n]') IF trim(x, ' ') <> ''], ' ')) AS cells FROM documents")
def extract_csv_cells(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.csv_cells(F.col("text")), 256).alias("cells"))


@query("SELECT page_id, sha256(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '')) AS text FROM pages")
def strip_tags_pages(s, d):
    return X.table(s, d, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text"))


_URLS = "u AS (SELECT page_id, regexp_replace(url, '[?].*$', '') AS p FROM pages)"


@query(f"WITH {_URLS} SELECT page_id, lower(regexp_extract(p, '\\.([^./]*)$', 1)) AS ext FROM u")
def file_extension(s, d):
    return X.table(s, d, "pages").select("page_id", T.extension(F.col("url")).alias("ext"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def xml_escape(s, d):
    return X.table(s, d, "pages").select("page_id", F.sha2(T.xml_escape(F.col("html")), 256).alias("escaped"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events")
def iso_time_parse(s, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return X.table(s, d, "events").select("event_id", F.unix_millis(F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("ms"))


@query(f"WITH {FILES} SELECT path, doc_id||'.txt' AS name, [x FOR x IN string_split(path, '/') IF x <> ''][1] AS first FROM files")
def breadcrumbs(s, d):
    crumbs = F.filter(F.split("path", "/"), lambda x: x != "")
    return files(s, d).select("path", F.element_at(crumbs, -1).alias("name"), F.element_at(crumbs, 1).alias("first"))


@query(f"WITH {FILES} SELECT '<Key>'||path||'</Key><Size>'||size||'</Size>' AS xml FROM files")
def object_listing(s, d):
    return files(s, d).select(F.concat(F.lit("<Key>"), T.xml_escape(F.col("path")), F.lit("</Key><Size>"), F.col("size").cast("string"), F.lit("</Size>")).alias("xml"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS principal FROM customer")
def principal_resolve(s, d):
    c = X.table(s, d, "customer").withColumn("claim", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")))
    return c.select("c_custkey", F.coalesce("claim", F.col("c_custkey").cast("string")).alias("principal"))


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 17 = 0 THEN 'modified' ELSE 'synced' END AS badge FROM files")
def sync_badge(s, d):
    f = files(s, d)
    state = f.filter("doc_id % 17 = 0").select("path", F.lit("modified").alias("b"))
    return f.join(state, "path", "left").select("path", F.coalesce("b", F.lit("synced")).alias("badge"))


@query("SELECT doc_id, text FROM documents WHERE doc_id = 42")
def kv_point_get(s, d):
    return docs(s, d).filter("doc_id = 42").select("doc_id", "text")


@query(f"WITH {FILES} SELECT path, hash FROM files WHERE starts_with(path, '/src1') ORDER BY path")
def kv_prefix_scan(s, d):
    return files(s, d).filter(F.col("path").startswith("/src1")).select("path", "hash").orderBy("path")


