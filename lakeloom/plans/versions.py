"""Queries on the versioned store: contents, directories, snapshots, commits, reachability and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lakeloom.operators import store as V
from lakeloom.plans.registry import CHUNKS, FILES, files, query
from lakeloom.sources import connectors as K
from lakeloom.sources import fixtures as X

#: The same trees, manifests, directories and commits in SQL.
TREES = f"""{FILES}, tf AS (SELECT 't1' AS tree, path, text FROM files UNION ALL SELECT 't1', '/odd', 'x' UNION ALL SELECT 't2', '/odd/inner.txt', 'x'
UNION ALL SELECT 't2', path, CASE WHEN doc_id % 7 = 0 THEN text||'!' ELSE text END FROM files WHERE doc_id % 11 <> 0 UNION ALL SELECT 't2', path||'.new', text FROM files WHERE doc_id % 13 = 0
UNION ALL SELECT 't3', path, text FROM files WHERE lang = 'en' UNION ALL SELECT 't4', path, text||'?' FROM files WHERE source = 'src1'),
tx AS (SELECT tree, path, hex(encode(text)) AS hx FROM tf),
tc AS (SELECT tree, path, i AS pos, unhex(substr(hx, CAST(i * 8192 + 1 AS BIGINT), 8192)) AS data FROM tx, unnest(range(0, CAST(ceil(length(hx) / 8192.0) AS BIGINT))) u(i)),
ts AS (SELECT tree, path, pos, sha256(data) AS hash, octet_length(data) AS len, data FROM tc),
tb AS (SELECT tx.tree, tx.path, CAST(any_value(length(hx)) // 2 AS BIGINT) AS size, sha256(coalesce(string_agg(hash||':'||len, ',' ORDER BY pos), '')) AS blob FROM tx LEFT JOIN ts ON tx.tree = ts.tree AND tx.path = ts.path GROUP BY 1, 2),
tm AS (SELECT *, sha256('file:'||blob) AS file, len(string_split(path, '/')) - 1 AS depth FROM tb)"""


def _up(p: str) -> str:
    return f"regexp_replace({p}, '/[^/]*$', '') AS p, regexp_extract({p}, '[^/]*$') AS name"


def _level(n: int) -> str:
    below = f" UNION ALL SELECT tree, {_up('p')}, 'dir', dh FROM g{n + 1}" if n < 3 else ""
    return f"l{n} AS (SELECT tree, {_up('path')}, 'file' AS kind, file AS h FROM tm WHERE depth = {n}{below}), g{n} AS (SELECT tree, p, sha256(string_agg(name||':'||kind||':'||h, ',' ORDER BY name)) AS dh FROM l{n} GROUP BY 1, 2)"


DIRS = TREES + ", " + ", ".join(map(_level, (3, 2, 1))) + """, gd AS (SELECT tree, p, dh FROM g1 UNION ALL SELECT tree, p, dh FROM g2 UNION ALL SELECT tree, p, dh FROM g3),
obj AS (SELECT tree, CASE WHEN p = '' THEN '/' ELSE p END AS path, 'dir' AS kind, dh AS hash, CAST(0 AS BIGINT) AS size FROM gd UNION ALL SELECT tree, path, 'file', file, size FROM tm)"""
COMMIT_ROWS = (("c1", "t1", []), ("c2", "t2", ["c1"]), ("c3", "t3", ["c1"]), ("c4", "t2", ["c2", "c3"]), ("c5", "t4", ["c1"]))
BRANCH_ROWS = (("main", "c4"), ("dev", "c3"))
GRAPH = "cm AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{t}', {p}::VARCHAR[])" for h, t, p in COMMIT_ROWS) + ") t(hash, tree, parents)), br AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{h}')" for n, h in BRANCH_ROWS) + ") t(name, head)), rc AS (SELECT head AS hash FROM br UNION SELECT unnest(parents) FROM cm JOIN rc ON cm.hash = rc.hash)"
LIVE = f"WITH RECURSIVE {DIRS}, {GRAPH}, lt AS (SELECT DISTINCT tree FROM cm JOIN rc ON cm.hash = rc.hash), al AS (SELECT DISTINCT hash FROM ts UNION SELECT sha256('orphan')), lc AS (SELECT DISTINCT hash FROM ts WHERE tree IN (SELECT tree FROM lt))"
HISTORY = """co AS (SELECT o_orderkey AS hash, o_custkey AS author, lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER w AS root, (epoch_us(o_orderdate) // 1000) AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
rt AS (SELECT DISTINCT author, root FROM co), hs AS (SELECT co.hash, co.author, ts, CASE WHEN before IS NOT NULL AND co.hash % 10 = 0 AND rt.root IS NOT NULL THEN [before, rt.root] WHEN before IS NOT NULL THEN [before] ELSE [] END AS parents FROM co LEFT JOIN rt ON rt.author = co.author + 1),
hd AS (SELECT 'b'||author AS branch, hash FROM co JOIN customer ON author = c_custkey WHERE nth = 1 AND c_mktsegment = 'BUILDING')"""


def trees(s, d):
    """tree, path, data of four trees: all documents; some changed, gone, copied, and a file that became a directory; those
    of one language; and those of one source, changed."""
    f = files(s, d)
    row = lambda tree, path, text, df: df.select(F.lit(tree).alias("tree"), path.alias("path"), text.cast("binary").alias("data"))
    path, text = F.col("path"), F.col("text")
    extra = s.createDataFrame([("t1", "/odd", "x"), ("t2", "/odd/inner.txt", "x")], "tree string, path string, text string")
    parts = [
        row("t1", path, text, f), extra.select("tree", "path", text.cast("binary").alias("data")),
        row("t2", path, F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("!"))).otherwise(text), f.filter("doc_id % 11 <> 0")),
        row("t2", F.concat(path, F.lit(".new")), text, f.filter("doc_id % 13 = 0")),
        row("t3", path, text, f.filter("lang = 'en'")), row("t4", path, F.concat(text, F.lit("?")), f.filter("source = 'src1'")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def manifests(s, d):
    return V.manifests(trees(s, d), X.CHUNK)


def entries(m):
    return V.merkle(m.select("tree", "path", F.col("file_hash").alias("object_hash"), F.lit("file").alias("kind")))


def root(e, tree):
    return V.roots(e).filter(F.col("tree") == tree).select(F.col("dir_hash").alias("hash"))


def commits(s, e):
    c = s.createDataFrame([(h, t, p, k) for k, (h, t, p) in enumerate(COMMIT_ROWS)], "hash string, tree string, parents array<string>, ts int")
    return c.join(F.broadcast(V.roots(e)), "tree").withColumnRenamed("dir_hash", "tree_hash")


def branches(s):
    return s.createDataFrame(list(BRANCH_ROWS), "name string, head string")


def objects(m, e):
    """tree, path, kind, hash, size of all directories and files."""
    dirs = e.select("tree", "path", F.lit("dir").alias("kind"), F.col("dir_hash").alias("hash"), F.lit(0).cast("long").alias("size")).distinct()
    return dirs.unionByName(m.select("tree", "path", F.lit("file").alias("kind"), F.col("file_hash").alias("hash"), "size"))


def chunk_store(s, d):
    """hash, data of all chunks there are, and one that nothing refers to."""
    rows = V.chunk_rows(trees(s, d).select("path", "data"), X.CHUNK).select("hash", "data")
    return rows.unionByName(s.range(1).select(F.sha2(F.lit("orphan"), 256).alias("hash"), F.lit("orphan").cast("binary").alias("data"))).dropDuplicates(["hash"])


def broken_store(s, d):
    """The chunks of the documents, those whose hash begins with 0 with a byte too many."""
    c = X.chunks(files(s, d)).select("hash", "data").dropDuplicates(["hash"])
    return c.withColumn("data", F.when(F.col("hash").startswith("0"), F.concat("data", F.unhex(F.lit("78")))).otherwise(F.col("data")))


# Contents ------------------------------------------------------------------------------------------------------------
@query(f"WITH {FILES}, {CHUNKS} SELECT path, pos, sha256(data) AS hash, CAST(octet_length(data) AS INTEGER) AS length FROM chunks")
def chunk_window(s, d):
    return X.chunks(files(s, d)).drop("data")


@query(f"WITH {FILES}, {CHUNKS} SELECT sha256(data) AS hash, min(octet_length(data)) AS length FROM chunks GROUP BY 1")
def chunk_dedup(s, d):
    return X.chunks(files(s, d)).groupBy("hash").agg(F.min("length").cast("long").alias("length"))


@query(f"WITH {FILES}, {CHUNKS}, b AS (SELECT path, pos, sha256(data) LIKE '0%' AS bad, CASE WHEN sha256(data) LIKE '0%' THEN hex(data)||'78' ELSE hex(data) END AS hx FROM chunks) SELECT f.path, CAST(count(*) FILTER (bad) AS INTEGER) AS n_bad, sha256(unhex(coalesce(string_agg(hx, '' ORDER BY pos), ''))) AS hash, CAST(coalesce(sum(length(hx)) // 2, 0) AS BIGINT) AS size FROM files f LEFT JOIN b ON f.path = b.path GROUP BY 1")
def file_reassemble(s, d):
    """All files from their manifests and the chunk table, in which some chunks are damaged."""
    m = V.manifests(files(s, d).select("path", F.col("text").cast("binary").alias("data")), X.CHUNK)
    return V.read_files(m.select("path", "chunks"), broken_store(s, d)).select("path", F.col("n_bad").cast("int").alias("n_bad"), F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("size"))


@query(f"WITH {FILES}, {CHUNKS}, h AS (SELECT DISTINCT sha256(data) AS hash FROM chunks) SELECT count(*) AS chunks, count(*) FILTER (hash LIKE '0%') AS failures FROM h")
def chunk_verify(s, d):
    return broken_store(s, d).agg(F.count("*").alias("chunks"), F.count_if(F.sha2("data", 256) != F.col("hash")).alias("failures"))


@query(f"WITH {FILES}, r AS (SELECT path, hex(encode(text)) AS hx, doc_id % 50 * 40 AS o, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 20 END AS n FROM files) SELECT path, sha256(unhex(substr(hx, CAST(least(o * 2, length(hx)) + 1 AS BIGINT), CASE WHEN n < 0 THEN length(hx) ELSE n * 2 END))) AS part FROM r")
def byte_range_read(s, d):
    data, n = F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(20)
    return files(s, d).select("path", F.sha2(V.byte_range(data, (F.col("doc_id") % 50 * 40).cast("int"), n), 256).alias("part"))


@query(f"WITH {FILES}, {CHUNKS}, h AS (SELECT DISTINCT sha256(data) AS hash FROM chunks) SELECT substr(hash, 1, 2) AS shard, count(*) AS n FROM h GROUP BY 1")
def chunk_shards(s, d):
    """Chunks by shard, of a store that is written and listed."""
    folder = K.scratch(s, "chunk-store")
    V.write_chunks(X.chunks(files(s, d)).select("hash", "data"), folder)
    return V.read_chunks(s, folder).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"WITH {FILES}, {CHUNKS}, w AS (SELECT unnest([sha256('orphan'), sha256('x'), repeat('f', 64)]) AS hash), h AS (SELECT DISTINCT sha256(data) AS hash, CAST(octet_length(data) AS INTEGER) AS size FROM chunks UNION SELECT sha256('orphan'), 6) SELECT w.hash, h.size IS NOT NULL AS there, h.size FROM w LEFT JOIN h ON w.hash = h.hash")
def chunk_get(s, d):
    folder = K.scratch(s, "chunk-store")
    orphan = s.range(1).select(F.sha2(F.lit("orphan"), 256).alias("hash"), F.lit("orphan").cast("binary").alias("data"))
    V.write_chunks(X.chunks(files(s, d)).select("hash", "data").unionByName(orphan), folder)
    wanted = [r[0] for r in s.range(1).select(F.explode(F.array(F.sha2(F.lit("orphan"), 256), F.sha2(F.lit("x"), 256), F.repeat(F.lit("f"), F.lit(64))))).collect()]
    return V.get_chunks(s, folder, wanted).drop("data")


@query(f"WITH {FILES} SELECT path, NOT (doc_id % 10 = 0 AND length(text) > 0) AS ok FROM files")
def manifest_seal_verify(s, d):
    """Blob manifests against their seals, some with a chunk's length changed after they were sealed."""
    m = V.manifests(files(s, d).select("path", "doc_id", F.col("text").cast("binary").alias("data")), X.CHUNK)
    longer = F.transform("chunks", lambda c: F.struct(c["hash"].alias("hash"), (c["length"] + 1).alias("length")))
    stored = m.withColumn("chunks", F.when(F.col("doc_id") % 10 == 0, longer).otherwise(F.col("chunks")))
    return stored.select("path", (V.blob_seal(F.col("chunks")) == F.col("blob_hash")).alias("ok"))


# Files and directories -----------------------------------------------------------------------------------------------
@query(f"WITH {DIRS} SELECT path, kind, hash, size FROM obj WHERE tree = 't1' AND regexp_replace(path, '/[^/]*$', '') = '/src1'")
def fs_list(s, d):
    m = manifests(s, d).filter("tree = 't1'")
    return objects(m, entries(m)).filter(V.parent(F.col("path")) == "/src1").select("path", "kind", "hash", "size").orderBy("path")


@query(f"WITH {DIRS} SELECT path, kind, hash, size FROM obj WHERE tree = 't1' AND starts_with(path, '/src1/')")
def fs_list_recursive(s, d):
    m = manifests(s, d).filter("tree = 't1'")
    e = entries(m)
    found = V.listing(e, V.resolve(e, root(e, "t1"), "/src1").select("hash")).withColumn("path", F.concat(F.lit("/src1"), "path"))
    sizes = m.select("path", "size")
    return found.join(sizes, "path", "left").select("path", "kind", "hash", F.coalesce("size", F.lit(0)).cast("long").alias("size")).orderBy("path")


@query(f"WITH {DIRS}, w AS (SELECT path FROM files WHERE doc_id IN (1, 21, 41) UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM files WHERE doc_id IN (1, 21, 41) UNION SELECT '/' UNION SELECT '/odd' UNION SELECT '/none') SELECT w.path, kind, hash, size FROM w LEFT JOIN obj ON w.path = obj.path AND tree = 't1'")
def fs_stat(s, d):
    """Files, directories (of size 0), the root, and a path that isn't there."""
    m = manifests(s, d).filter("tree = 't1'")
    some = files(s, d).filter("doc_id in (1, 21, 41)").select("path")
    wanted = some.union(some.select(V.parent(F.col("path")))).union(s.createDataFrame([("/",), ("/odd",), ("/none",)], "path string")).distinct()
    return F.broadcast(wanted).join(objects(m, entries(m)), "path", "left").select("path", "kind", "hash", "size")


@query(f"WITH {DIRS} SELECT split_part(path, '/', 2) AS top, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS dirs, CAST(sum(size) AS BIGINT) AS bytes FROM obj WHERE tree = 't1' AND path <> '/' GROUP BY 1")
def fs_subtree(s, d):
    """What a walk from the root finds under each top directory."""
    m = manifests(s, d).filter("tree = 't1'")
    e = entries(m)
    found = V.listing(e, root(e, "t1")).join(m.select("path", "size"), "path", "left")
    return found.groupBy(F.split("path", "/")[1].alias("top")).agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query(f"WITH {DIRS} SELECT tree, path, hash FROM obj WHERE kind = 'dir'")
def merkle_rebuild(s, d):
    """Directory hashes of all trees, from the deepest up."""
    return entries(manifests(s, d)).select("tree", "path", F.col("dir_hash").alias("hash")).distinct()


@query(f"WITH {DIRS} SELECT path, blob AS blob_hash, file AS file_hash, size FROM tm WHERE tree = 't2' UNION ALL SELECT path, blob, file, size FROM tm WHERE tree = 't1' AND path NOT IN (SELECT path FROM tm WHERE tree = 't2')")
def fs_write_upsert(s, d):
    """The snapshot after t2's files are written over t1's: contents are cut, sealed and put in place of the old ones."""
    m = manifests(s, d).select("tree", "path", "blob_hash", "file_hash", "size")
    return V.put(m.filter("tree = 't1'").drop("tree"), m.filter("tree = 't2'").drop("tree"))


@query(f"WITH {FILES}, a AS (SELECT path, CASE WHEN source = 'src3' THEN text||'!' ELSE text END AS t FROM files UNION ALL SELECT '/new.txt', '!') SELECT path, sha256(t) AS hash, CAST(octet_length(encode(t)) AS BIGINT) AS size FROM a")
def fs_append(s, d):
    """The whole snapshot after an append to each file of one source, and to one that isn't there."""
    f = files(s, d).select("path", "source", F.col("text").cast("binary").alias("data"))
    tail = F.lit("!").cast("binary")
    more = f.filter("source = 'src3'").select("path", tail.alias("data")).union(s.range(1).select(F.lit("/new.txt"), tail))
    return V.append(f.select("path", "data"), more, X.CHUNK).select("path", F.sha2("data", 256).alias("hash"), "size")


@query(f"WITH {FILES}, w AS (SELECT path FROM files WHERE doc_id = 21 UNION ALL SELECT unnest(['/', '/src1', '/empty', '/none'])) SELECT path, CASE WHEN path = '/' THEN 'root' WHEN path IN (SELECT path FROM files) OR path = '/empty' THEN 'ok' WHEN path = '/src1' THEN 'not empty' ELSE 'missing' END AS result FROM w")
def fs_delete(s, d):
    f = files(s, d)
    wanted = f.filter("doc_id = 21").select("path").union(s.createDataFrame([("/",), ("/src1",), ("/empty",), ("/none",)], "path string"))
    return V.delete_results(f.select("path"), s.createDataFrame([("/empty",)], "path string"), wanted)


@query(f"WITH {FILES}, w AS (SELECT path FROM files WHERE doc_id = 21 UNION ALL SELECT path||'/x' FROM files WHERE doc_id = 21 UNION ALL SELECT unnest(['/', '/src1', '/empty', '/src1/new/deep'])) SELECT path, CASE WHEN path LIKE '%.txt%' THEN 'exists' ELSE 'ok' END AS result, path = '/src1/new/deep' AS new FROM w")
def fs_mkdir(s, d):
    f = files(s, d)
    one = f.filter("doc_id = 21").select("path")
    wanted = one.union(one.select(F.concat("path", F.lit("/x")))).union(s.createDataFrame([("/",), ("/src1",), ("/empty",), ("/src1/new/deep",)], "path string"))
    return V.mkdir_results(f.select("path"), s.createDataFrame([("/empty",)], "path string"), wanted)


@query("WITH t AS (SELECT 'k'||c_custkey AS key, c_name AS value, c_custkey AS n FROM customer) SELECT key, CASE WHEN n % 3 = 0 THEN 'late' ELSE value END AS value FROM t WHERE n % 5 <> 0 OR n % 3 = 0 UNION ALL SELECT 'new', 'v'")
def kv_batch(s, d):
    """A batch of puts and deletes on a table of keys, of which the last on a key counts."""
    t = X.table(s, d, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("n"))
    gone = t.filter("n % 5 = 0").select(F.lit(1).alias("ord"), F.lit("delete").alias("op"), "key", F.lit(None).cast("string").alias("value"))
    early = t.filter("n % 3 = 0").select(F.lit(0).alias("ord"), F.lit("put").alias("op"), "key", F.lit("early").alias("value"))
    ops = gone.union(early).union(early.withColumns({"ord": F.lit(2), "value": F.lit("late")})).union(s.createDataFrame([(0, "put", "new", "v")], "ord int, op string, key string, value string"))
    return V.apply_batch(t.drop("n"), ops)


# Versions ------------------------------------------------------------------------------------------------------------
def history(s, d):
    return X.history(X.table(s, d, "orders"))


def heads(s, d):
    """branch, hash: a branch for each customer of one segment, at its last commit."""
    last = X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("hash"))
    of = X.table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("author"))
    return last.join(of, "author").select(F.concat(F.lit("b"), F.col("author").cast("string")).alias("branch"), "hash")


@query(f"WITH RECURSIVE {HISTORY}, r AS (SELECT branch, 0 AS depth, hash FROM hd UNION ALL SELECT branch, depth + 1, parents[1] FROM r JOIN hs ON r.hash = hs.hash WHERE len(parents) > 0 AND depth < 4) SELECT branch, CAST(depth AS BIGINT) AS depth, r.hash, array_to_string(parents, ',') AS parents, 'u'||author AS author, 'u'||author||'@example.com' AS email, ts, sha256('t'||r.hash) AS tree, 'order '||r.hash AS message FROM r JOIN hs ON r.hash = hs.hash")
def commit_log_first_parent(s, d):
    log = V.first_parent_log(history(s, d), heads(s, d), 5)
    return log.select("branch", "depth", "hash", F.array_join(F.transform("parents", lambda p: p.cast("string")), ",").alias("parents"), "author", "email", "ts", "tree", "message")


@query(f"WITH RECURSIVE {HISTORY}, r AS (SELECT hash FROM hd UNION SELECT unnest(parents) FROM hs JOIN r ON hs.hash = r.hash) SELECT hash FROM r")
def commit_reachability(s, d):
    """All commits that the branches reach over all parents, merges included."""
    return V.reachable(history(s, d), heads(s, d))


@query(f"WITH {HISTORY} SELECT branch AS name, hash AS head FROM hd")
def branch_list(s, d):
    return heads(s, d).select(F.col("branch").alias("name"), F.col("hash").alias("head"))


@query(f"WITH {HISTORY} SELECT author, CASE WHEN author % 5 = 0 THEN 'detached' ELSE 'branch' END AS kind, CASE WHEN author % 5 = 0 THEN root ELSE hash END AS head FROM co WHERE nth = 1")
def head_resolve(s, d):
    """The commit that each working copy's HEAD stands for: that of its branch, or one by hash."""
    o = X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))
    name = F.concat(F.lit("b"), F.col("author").cast("string"))
    detached = F.col("author") % 5 == 0
    state = o.select("author", F.when(detached, "detached").otherwise("branch").alias("kind"), F.when(detached, F.col("first").cast("string")).otherwise(name).alias("target"))
    known = o.select(name.alias("target"), "last")
    return state.join(known, "target", "left").select("author", "kind", F.when(F.col("kind") == "branch", F.col("last")).otherwise(F.col("target").try_cast("long")).alias("head"))


@query(f"WITH {TREES} SELECT path, file AS hash FROM tm WHERE tree = 't2'")
def checkout_snapshot(s, d):
    """The files of a commit's tree, by a walk from its root."""
    e = entries(manifests(s, d).filter("tree = 't2'"))
    return V.listing(e, root(e, "t2")).filter("kind = 'file'").select("path", "hash")


def _diff(a: str, b: str) -> str:
    return f"WITH {TREES}, a AS (SELECT path, file FROM tm WHERE tree = '{a}'), b AS (SELECT path, file FROM tm WHERE tree = '{b}'), j AS (SELECT coalesce(a.path, b.path) AS path, a.file AS af, b.file AS bf FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.file IS DISTINCT FROM b.file) SELECT CASE WHEN path = '/odd' AND '{b}' = 't2' THEN 'mod' WHEN af IS NULL THEN 'add' WHEN bf IS NULL THEN 'del' ELSE 'mod' END AS op, path FROM j WHERE NOT starts_with(path, '/odd/')"


@query(_diff("t1", "t2"))
def tree_diff(s, d):
    e = entries(manifests(s, d).filter("tree in ('t1', 't2')"))
    return V.diff_trees(e, root(e, "t1"), root(e, "t2"))


@query(_diff("t1", "t3"))
def version_diff_defaults(s, d):
    """From the first parent of HEAD, here the branch dev, to HEAD."""
    e = entries(manifests(s, d))
    c = commits(s, e)
    head = branches(s).filter("name = 'dev'").join(c, F.col("head") == F.col("hash")).select("tree_hash", "parents")
    base = c.join(head.select(F.get("parents", F.lit(0)).alias("hash")), "hash").select(F.col("tree_hash").alias("hash"))
    return V.diff_trees(e, base, head.select(F.col("tree_hash").alias("hash")))


@query(f"WITH RECURSIVE {DIRS}, {GRAPH} SELECT 'branch' AS kind, name AS key, head AS value FROM br UNION ALL SELECT 'commit', cm.hash, obj.hash FROM cm JOIN obj ON cm.tree = obj.tree AND obj.path = '/' UNION ALL SELECT 'dir', dh, CAST(count(DISTINCT name) AS VARCHAR) FROM g1 JOIN l1 ON g1.tree = l1.tree WHERE g1.tree = 't1' GROUP BY 2 UNION ALL SELECT 'file', file, any_value(blob) FROM tm WHERE tree = 't4' GROUP BY 2")
def typed_get(s, d):
    """Records of each kind by key: branches, commits, a directory, and the files of a tree."""
    m = manifests(s, d)
    e = entries(m)
    wanted = root(e, "t1").withColumnRenamed("hash", "dir_hash")
    parts = [
        branches(s).select(F.lit("branch").alias("kind"), F.col("name").alias("key"), F.col("head").alias("value")),
        commits(s, e).select(F.lit("commit"), "hash", "tree_hash"),
        e.join(F.broadcast(wanted), "dir_hash", "left_semi").groupBy("dir_hash").agg(F.count_distinct("name").cast("string").alias("n")).select(F.lit("dir"), "dir_hash", "n"),
        m.filter("tree = 't4'").select(F.lit("file"), "file_hash", "blob_hash").distinct(),
    ]
    return reduce(lambda a, b: a.union(b), parts)


# Reachability --------------------------------------------------------------------------------------------------------
def live(s, d):
    m = V.written(manifests(s, d).select("tree", "path", "file_hash", "blob_hash", "chunks"), "manifests")
    e = V.written(entries(m), "entries")
    found = V.live_objects(commits(s, e), branches(s).select(F.col("head").alias("hash")), e)
    return found, V.live_chunks(found, m, m)


@query(f"{LIVE} SELECT hash FROM al WHERE hash NOT IN (SELECT hash FROM lc)")
def gc_mark_sweep(s, d):
    """Chunks that no branch reaches over its commits, trees, files and blobs."""
    return V.sweep(chunk_store(s, d).select("hash"), live(s, d)[1])[1]


@query(f"{LIVE} SELECT (SELECT count(*) FROM al) AS seen, (SELECT count(*) FROM lc) AS marked, (SELECT count(*) FROM al WHERE hash NOT IN (SELECT hash FROM lc)) AS swept, (SELECT count(*) FROM rc) + (SELECT count(DISTINCT hash) FROM obj WHERE tree IN (SELECT tree FROM lt)) AS manifests, (SELECT count(*) FROM al) AS left_by_dry_run")
def gc_report(s, d):
    found, chunks = live(s, d)
    all_ = V.written(chunk_store(s, d).select("hash"), "chunk-hashes")
    stay, swept = V.sweep(all_, chunks, dry_run=True)
    counts = [all_.agg(F.count("*").alias("seen")), chunks.agg(F.count("*").alias("marked")), swept.agg(F.count("*").alias("swept")), found.agg(F.count_distinct("hash").alias("manifests")), stay.agg(F.count("*").alias("left_by_dry_run"))]
    return reduce(lambda a, b: a.crossJoin(b), counts)


@query(f"{LIVE}, u AS (SELECT file, any_value(tree) AS tree, any_value(path) AS path FROM tm WHERE tree IN (SELECT tree FROM lt) GROUP BY 1) SELECT hash, count(*) AS refs FROM (SELECT u.file, min(ts.tree||ts.path) AS one, pos, hash FROM u JOIN tm ON tm.file = u.file JOIN ts ON ts.tree = tm.tree AND ts.path = tm.path GROUP BY u.file, pos, hash) GROUP BY 1")
def gc_refcounts(s, d):
    """References from unique live file manifests; a chunk that stands twice in one counts twice."""
    return live(s, d)[1]


@query(f"{LIVE} SELECT hash FROM al WHERE hash NOT IN (SELECT hash FROM lc)")
def gc_sweep_zero(s, d):
    refs = live(s, d)[1]
    return chunk_store(s, d).select("hash").join(refs, "hash", "left").filter(F.coalesce("refs", F.lit(0)) == 0).select("hash")


@query(f"WITH {FILES}, {CHUNKS}, h AS (SELECT DISTINCT sha256(data) AS hash FROM chunks) SELECT 'no-corrupt-chunks' AS name, count(*) FILTER (hash LIKE '0%') = 0 AS holds, count(*) FILTER (hash LIKE '0%') AS violations FROM h UNION ALL SELECT 'gc-keeps-live', true, 0 UNION ALL SELECT 'careless-gc-keeps-live', count(*) FILTER (hash LIKE '1%') = 0, count(*) FILTER (hash LIKE '1%') FROM h")
def chaos_invariants(s, d):
    """Invariants of a store that was tampered with: damaged chunks, a sweep, and a sweep that took live chunks too."""
    broken = broken_store(s, d)
    refs = X.chunks(files(s, d)).select("hash").distinct()
    stay, _ = V.sweep(broken, refs)
    lost = lambda kept: refs.join(kept.select("hash"), "hash", "left_anti")
    parts = [("no-corrupt-chunks", V.damaged(broken)), ("gc-keeps-live", lost(stay)), ("careless-gc-keeps-live", lost(stay.filter(~F.col("hash").startswith("1"))))]
    return reduce(lambda a, b: a.union(b), [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("name"), (F.col("violations") == 0).alias("holds"), "violations") for n, df in parts])


# Backups -------------------------------------------------------------------------------------------------------------
@query(f"{LIVE} SELECT hash FROM al WHERE hash NOT IN (SELECT hash FROM ts WHERE tree IN ('t1', 't3'))")
def backup_new_chunks(s, d):
    """Chunks that no backup of the chain has: one of t1, one of t3."""
    m = manifests(s, d)
    known = reduce(lambda a, b: a.union(b), [m.filter(F.col("tree") == t).select(F.explode("chunks.hash").alias("hash")) for t in ("t1", "t3")]).distinct()
    return chunk_store(s, d).select("hash").join(known, "hash", "left_anti")


CHAIN = f"{TREES}, fx AS (SELECT tree, hash, any_value(len) AS len, min(tree) OVER (PARTITION BY hash) AS first FROM ts GROUP BY tree, hash)"


def _chain(s, d):
    """backup, hash, length: each tree's chunks that no backup before it has."""
    c = manifests(s, d).select("tree", F.inline("chunks")).distinct()
    return c.groupBy("hash").agg(F.min("tree").alias("backup"), F.min("length").alias("length"))


@query(f"WITH {CHAIN}, n AS (SELECT * FROM fx WHERE tree = first), b AS (SELECT tree AS id, count(*) AS chunk_count, CAST(sum(len) AS BIGINT) AS byte_count FROM n GROUP BY 1) SELECT id, lag(id) OVER (ORDER BY id) AS parent_id, lag(id) OVER (ORDER BY id) IS NULL AS is_full, chunk_count, byte_count FROM b")
def backup_record(s, d):
    """Backups of the trees one after the other, each with the chunks that those before it lack, and its parent."""
    from pyspark.sql import Window

    b = _chain(s, d).groupBy(F.col("backup").alias("id")).agg(F.count("*").alias("chunk_count"), F.sum("length").alias("byte_count"))
    before = F.lag("id").over(Window.orderBy("id"))  # a row for each backup
    return b.withColumn("parent_id", before).select("id", "parent_id", F.col("parent_id").isNull().alias("is_full"), "chunk_count", "byte_count")


@query(f"WITH {CHAIN}, n AS (SELECT * FROM fx WHERE tree = first) SELECT CAST(sum(len) AS BIGINT) AS total_bytes, count(DISTINCT CASE WHEN tree = (SELECT min(tree) FROM n) THEN tree END) AS full_count, count(*) AS known_chunks FROM n")
def backup_chain_summary(s, d):
    c = backup_record(s, d)
    known = _chain(s, d).agg(F.count_distinct("hash").alias("known_chunks"))
    return c.agg(F.sum("byte_count").alias("total_bytes"), F.count_if("is_full").alias("full_count")).crossJoin(known)


@query(f"WITH {FILES}, {CHUNKS}, h AS (SELECT DISTINCT sha256(data) AS hash, octet_length(data) AS n FROM chunks) SELECT 'c1' AS commit, count(*) AS chunk_count, CAST(sum(n) AS BIGINT) AS byte_count, count(*) AS chunks, 0 AS failures, true AS sealed, true AS smaller FROM h UNION ALL SELECT 'broken', count(*), CAST(sum(n) AS BIGINT) + count(*) FILTER (hash LIKE '0%'), count(*), count(*) FILTER (hash LIKE '0%'), true, true FROM h")
def backup_export(s, d):
    """Bundles of all chunks, whole and damaged ones, written, read back and verified."""
    out = []
    for commit, chunks in (("c1", X.chunks(files(s, d))), ("broken", broken_store(s, d))):
        folder = K.scratch(s, "bundle")
        m = V.export_bundle(chunks, folder, commit)
        ratio = V.compression_ratio(F.col("byte_count"), F.col("compressed_bytes"))
        out.append(m.crossJoin(V.verify_bundle(s, folder)).select("commit", "chunk_count", "byte_count", "chunks", "failures", "sealed", (ratio > 1).alias("smaller")))
    return out[0].union(out[1])


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE round(p_retailprice / (p_size % 5), 6) END AS ratio, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE round(p_partkey * 1048576 / 1048576.0 / ((p_size % 7) / 1000.0), 6) END AS mbs FROM part")
def backup_export_stats(s, d):
    """Compression ratio and throughput of exports, some of which took no bytes or no time."""
    p = X.table(s, d, "part")
    ratio = V.compression_ratio(F.col("p_retailprice"), F.col("p_size") % 5)
    rate = V.throughput_mbs(F.col("p_partkey") * (1 << 20), F.col("p_size") % 7)
    return p.select(F.col("p_partkey").alias("id"), F.round(ratio, 6).alias("ratio"), F.round(rate, 6).alias("mbs"))
