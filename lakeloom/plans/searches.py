"""Queries of text, vector and hybrid search, and of ingest and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import ingest as I
from lakeloom.operators import search as S
from lakeloom.operators import textindex as P
from lakeloom.plans.registry import FILES, VECTORS, _cos, _query_vector, _redact_sql, docs, files, query, vectors
from lakeloom.sources import fixtures as X

_INDEXES: dict[tuple[str, str], P.Index] = {}


def index(s, d) -> P.Index:
    """The index of a folder's documents; it is built once a session, as a service would keep it."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = P.build(files(s, d))
    return _INDEXES[key]


# SQL of a query: leaves are words, phrases (several words) or paths
_TK = f"WITH {FILES}, t AS (SELECT doc_id, path, hash, text, [x FOR x IN regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS tk FROM files)"


def _leaf_sql(leaves: list[tuple[str, ...]], words: list[str]) -> str:
    def tf(x):
        if len(x) == 1:
            return f"len([y FOR y IN tk IF y = '{x[0]}'])"
        return "len([i FOR i IN range(1, len(tk) + 1) IF " + " AND ".join(f"coalesce(tk[i + {k}] = '{w}', false)" for k, w in enumerate(x)) + "])"

    f = ", ".join([f"{tf(x)} AS tf{k}" for k, x in enumerate(leaves)] + [f"list_contains(tk, '{w}') AS has{k}" for k, w in enumerate(words)])
    df = ", ".join(f"count(*) FILTER (has{k}) AS df{k}" for k in range(len(words)))
    idf = lambda w: f"ln(1 + (n - df{words.index(w)} + 0.5) / (df{words.index(w)} + 0.5))"
    s = ", ".join(f"CASE WHEN tf{k} > 0 THEN ({' + '.join(map(idf, x))}) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len / avgdl)) END AS s{k}" for k, x in enumerate(leaves))
    return f"f AS (SELECT doc_id, path, hash, text, len(tk) AS len, {f} FROM t), st AS (SELECT count(*) AS n, avg(len) AS avgdl, {df} FROM f), sc AS (SELECT doc_id, path, hash, text, n, {s} FROM f, st)"


def _search_sql(leaves, where: str) -> str:
    words = sorted({w for x in leaves for w in x})
    total = " + ".join(f"coalesce(s{k}, 0)" for k in range(len(leaves)))
    return f"{_leaf_sql(leaves, words)}, hits AS (SELECT doc_id, path, hash, text, round({total}, 6) AS score FROM sc WHERE {where})"


_WORDS = [("the",), ("tion",), ("and",)]
_ANY, _ALL = "s0 IS NOT NULL OR s1 IS NOT NULL OR s2 IS NOT NULL", "s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL"


@query(f"{_TK}, {_search_sql(_WORDS, _ANY)} SELECT doc_id, score FROM hits ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(s, d):
    return P.search(index(s, d), "the tion and").orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"{_TK}, {_search_sql(_WORDS, _ALL)} SELECT doc_id, score FROM hits")
def bm25_and(s, d):
    return P.search(index(s, d), "the AND tion AND and")


@query(f"{_TK}, {_search_sql([('the',), ('and',), ('of', 'the')], 's0 IS NOT NULL AND s1 IS NULL AND s2 IS NOT NULL')} SELECT doc_id, score FROM hits")
def search_required(s, d):
    return P.search(index(s, d), '+the -and +"of the"')


@query(f"{_TK}, {_search_sql([('of', 'the'), ('que',), ('de',)], 's0 IS NOT NULL OR (s1 IS NOT NULL AND s2 IS NOT NULL)')} SELECT doc_id, round(CASE WHEN s0 IS NOT NULL THEN s0 ELSE 0 END + CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN s1 + s2 ELSE 0 END, 6) AS score FROM sc WHERE s0 IS NOT NULL OR (s1 IS NOT NULL AND s2 IS NOT NULL)")
def search_grouped(s, d):
    return P.search(index(s, d), 'text:"of the" OR (text:que AND text:de)')


@query(f"{_TK}, {_search_sql([('the',)], 's0 IS NOT NULL')} SELECT doc_id, round(coalesce(s0, 0) + CASE WHEN doc_id = 1 THEN ln(1 + (n - 0.5) / 1.5) ELSE 0 END, 6) AS score FROM sc WHERE s0 IS NOT NULL OR doc_id = 1")
def search_path_field(s, d):
    """A word, or one document by its path."""
    path = files(s, d).filter("doc_id = 1").select("path").first()[0]
    return P.search(index(s, d), f"text:the OR path:{path}")


@query(f"{_TK}, {_search_sql([('of', 'the')], 's0 IS NOT NULL')} SELECT doc_id, score FROM hits")
def phrase_match(s, d):
    return P.search(index(s, d), 'text:"of the"')


@query(f"WITH {FILES}, p AS (SELECT doc_id, regexp_replace(text, '<[^>]*>', '', 'g') AS t FROM files WHERE list_contains(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), 'the')), w AS (SELECT doc_id, t, b, len(list_filter(regexp_split_to_array(substr(t, b, 150), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x IN ('the', 'of'))) AS n FROM p, unnest(range(1, greatest(2, length(t) + 1), 75)) u(b)) SELECT doc_id, arg_max(substr(t, b, 150), (n, -b)) AS snippet FROM w GROUP BY 1")
def snippet(s, d):
    """For each document with a word, the stretch that has most of two words."""
    has = F.array_contains(S.tokens(F.col("text")), "the")
    return docs(s, d).filter(has).select("doc_id", P.excerpt(F.col("text"), ["the", "of"]).alias("snippet"))


_EXCERPT = "w AS (SELECT doc_id, path, hash, score, regexp_replace(text, '<[^>]*>', '', 'g') AS t FROM hits ORDER BY score DESC, doc_id LIMIT 10), x AS (SELECT *, len(list_filter(regexp_split_to_array(substr(t, b, 150), '[^\\p{L}\\p{N}]+'), lambda x: x IN ('the', 'tion', 'and'))) AS n FROM w, unnest(range(1, greatest(2, length(t) + 1), 75)) u(b))"


@query(f"{_TK}, {_search_sql(_WORDS, _ANY)}, {_EXCERPT} SELECT doc_id, path, hash, score, arg_max(substr(t, b, 150), (n, -b)) AS snippet FROM x GROUP BY 1, 2, 3, 4")
def search_hits(s, d):
    """What a search shows: path, hash, score and an excerpt of the best matches."""
    return P.hits(index(s, d), docs(s, d), "the tion and")


@query(f"{_TK.replace('FROM documents', 'FROM (SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN text||chr(32)||chr(116)||chr(104)||chr(101) ELSE text END AS text) FROM documents WHERE doc_id % 7 <> 3)')}, {_search_sql([('the',)], 's0 IS NOT NULL')} SELECT doc_id, score FROM hits")
def index_upsert(s, d):
    """A search after some documents were changed in the index and others taken out of it."""
    f = files(s, d)
    changed = P.upsert(index(s, d), f.filter("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" the"))))
    return P.search(P.delete(changed, f.filter("doc_id % 7 = 3")), "text:the")


@query("SELECT 'text' AS side, doc_id AS id FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'vector', vec_id FROM embeddings WHERE vec_id % 5 <> 0")
def doc_delete(s, d):
    """Documents taken out of the text index and out of the vectors."""
    gone = X.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")).filter("doc_id % 5 = 0").union(docs(s, d).filter("doc_id % 5 = 0").select("doc_id")).distinct()
    left = P.delete(index(s, d), gone).documents.select(F.lit("text").alias("side"), F.col("doc_id").alias("id"))
    kept = vectors(s, d).join(gone.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_anti")
    return left.union(kept.select(F.lit("vector"), "vec_id"))


# Hybrid --------------------------------------------------------------------------------------------------------------
def _hybrid(weight: float, where: str = "true", limit: int = 10) -> str:
    fetch = max(4 * limit, 20)
    return f"{_TK}, {_search_sql(_WORDS, _ANY)}, th AS (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT {fetch}), vh AS (SELECT vec_id AS doc_id, score FROM ({_cos('true', fetch)})), a AS (SELECT doc_id, greatest(0, score / greatest((SELECT max(score) FROM th), 1.1920929e-7)) AS t FROM th), b AS (SELECT doc_id, greatest(0, score / greatest((SELECT max(score) FROM vh), 1.1920929e-7)) AS v FROM vh) SELECT doc_id, round({1 - weight} * coalesce(t, 0) + {weight} * coalesce(v, 0), 6) AS score FROM a FULL OUTER JOIN b USING (doc_id) WHERE {where} ORDER BY score DESC, doc_id LIMIT {limit}"


def _legs(s, d, limit=10):
    fetch = max(4 * limit, 20)
    v = vectors(s, d)
    text = P.search(index(s, d), "the tion and").orderBy(F.desc("score"), "doc_id").limit(fetch)
    return text, S.vector_topk(v, _query_vector(v), fetch).select(F.col("vec_id").alias("doc_id"), "score")


@query(_hybrid(0.5))
def hybrid_search(s, d):
    return S.hybrid(*_legs(s, d), 0.5, 10)


@query(_hybrid(0.0))
def hybrid_text_only(s, d):
    return S.hybrid(*_legs(s, d), 0.0, 10)


@query(_hybrid(1.0))
def hybrid_vector_only(s, d):
    return S.hybrid(*_legs(s, d), 1.0, 10)


@query(_hybrid(0.5, "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def hybrid_xattr_filter(s, d):
    t, v = _legs(s, d)
    wanted = docs(s, d).filter("lang = 'en'").select("doc_id")
    return S.hybrid(t, v, 0.5, 1 << 30).join(wanted, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"{_TK}, {_search_sql(_WORDS, _ANY)} SELECT doc_id, score FROM hits WHERE doc_id IN (SELECT doc_id FROM documents WHERE source LIKE 'src1%')")
def search_path_prefix(s, d):
    wanted = files(s, d).filter(F.col("path").startswith("/src1")).select("doc_id")
    return P.search(index(s, d), "the tion and").join(wanted, "doc_id", "left_semi")


# Ingest and embedding ------------------------------------------------------------------------------------------------
_EMBED = "[" + ", ".join(f"len(list_filter(tk, lambda x: length(x) % {I.DIMENSIONS} = {k}))" for k in range(I.DIMENSIONS)) + "]"


@query(f"WITH f AS (SELECT doc_id, lang, {_redact_sql('text')} AS x FROM documents WHERE lang IS DISTINCT FROM 'fr'), t AS (SELECT doc_id, x, [y FOR y IN regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}]+') IF y <> ''] AS tk FROM f) SELECT doc_id, length(x) AS n, CASE WHEN length(x) % 13 = 0 THEN '' ELSE array_to_string({_EMBED}, ',') END AS embedding, CASE WHEN length(x) % 13 = 0 THEN '' ELSE 'lengths-v1' END AS model_version, (SELECT count(*) FROM documents) AS seen FROM t")
def ingest_documents(s, d):
    """All documents as files: text taken from them and redacted, those of one language kept out, the rest embedded (by an
    embedder that fails on some texts, which then are stored without a vector) and counted, those kept out too."""
    f = files(s, d).select("doc_id", "path", "lang", "source", F.col("text").cast("binary").alias("content"))
    f = f.withColumn("xattrs", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    out = I.ingest(f, allow=I.deny_list(("lang", "fr")), embed=I.length_counts, model="lengths-v1", redact=True)
    seen = f.agg(F.count("*").alias("seen"))
    shown = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return out.select("doc_id", F.char_length("text").cast("long").alias("n"), shown.alias("embedding"), "model_version").crossJoin(F.broadcast(seen))


@query("SELECT doc_id, length(text) AS n, NOT coalesce(lang = 'fr', false) AS listed, true AS all FROM documents")
def ingest_allow_all(s, d):
    """The filter that lets all pass beside one with a deny-list."""
    f = docs(s, d).withColumn("xattrs", F.create_map(F.lit("lang"), "lang"))
    deny, all_ = I.deny_list(("lang", "fr")), I.allow_all()
    return f.select("doc_id", F.char_length("text").cast("long").alias("n"), deny(F.col("xattrs")).alias("listed"), all_(F.col("xattrs")).alias("all"))


@query("SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'fr', false) AND NOT coalesce(source = 'src3', false)")
def xattr_denylist(s, d):
    m = docs(s, d).withColumn("xattrs", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return m.filter(I.deny_list(("lang", "fr"), ("source", "src3"))(F.col("xattrs"))).select("doc_id")


_STALE = f"WITH {VECTORS}, st AS (SELECT vec_id, label, model_version, text, [y FOR y IN regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+') IF y <> ''] AS tk FROM vectors LEFT JOIN documents ON vec_id = doc_id), rs AS (SELECT *, text IS NOT NULL AND length(text) % 13 <> 0 AS ok FROM st WHERE model_version <> 'lengths-v1' AND label < 5)"


def _stale(s, d):
    """Vectors, those of some labels made by an older model."""
    v = vectors(s, d).withColumn("xattrs", F.create_map(F.lit("label"), F.col("label").cast("string")))
    v = v.withColumn("model_version", F.when(F.col("label") >= 5, "lengths-v1").otherwise(F.col("model_version")))
    texts = docs(s, d).select(F.col("doc_id").alias("vec_id"), "text")
    return I.reembed(S.mark_stale(v, "lengths-v1"), texts, I.length_counts, "lengths-v1")


@query(f"{_STALE} SELECT count(*) AS stale_found, count(*) FILTER (ok) AS reembedded, count(*) FILTER (NOT ok) AS failed FROM rs")
def reembed_report(s, d):
    return I.reembed_report(_stale(s, d))


@query(f"{_STALE} SELECT vec_id, array_to_string({_EMBED}, ',') AS embedding, 'lengths-v1' AS model_version, CAST(label AS VARCHAR) AS label FROM rs WHERE ok")
def reembed_stale(s, d):
    """Vectors made anew from their documents' texts; attributes stay."""
    shown = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return _stale(s, d).filter("result = 'done'").select("vec_id", shown.alias("embedding"), "model_version", F.col("xattrs")["label"].alias("label"))


@query(f"WITH t AS (SELECT doc_id, [y FOR y IN regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+') IF y <> ''] AS tk, length(text) AS n FROM documents), e AS (SELECT doc_id, CAST({_EMBED} AS DOUBLE[]) AS v FROM t WHERE n % 13 <> 0), q AS (SELECT v AS q FROM e ORDER BY doc_id LIMIT 1) SELECT doc_id, round(CASE WHEN list_sum([x * x FOR x IN v]) = 0 THEN 0 ELSE list_cosine_similarity(v, q) END, 6) AS score FROM e, q ORDER BY score DESC, doc_id LIMIT 10")
def find_near(s, d):
    """Documents nearest to one that is embedded for the search."""
    f = files(s, d).select("doc_id", "path", "lang", "source", F.col("text").cast("binary").alias("content")).withColumn("xattrs", F.create_map(F.lit("lang"), "lang"))
    e = I.ingest(f, allow=I.allow_all(), embed=I.length_counts, model="lengths-v1").filter("size(embedding) > 0")
    q = e.orderBy("doc_id").limit(1).select(F.col("embedding").alias("q"))
    return S.vector_topk(e.select("doc_id", "embedding"), q, 10, key="doc_id").select("doc_id", "score")


@query("SELECT CAST(32 + label AS BIGINT) AS dim, count(*) AS n FROM embeddings WHERE label IN (3, 7) GROUP BY 1")
def vector_dim_filter(s, d):
    """Vectors of as many components as two queries, among some of many lengths."""
    v = vectors(s, d).withColumn("embedding", F.slice("embedding", F.lit(1), F.lit(32) + F.col("label")))
    q = v.filter("label in (3, 7)").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    parts = [S.vector_topk(v, q.filter(F.col("label") == k).select("q"), 1 << 30) for k in (3, 7)]
    return parts[0].union(parts[1]).groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))
