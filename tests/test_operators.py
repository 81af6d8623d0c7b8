"""Operators on small inputs."""

import bisect
import datetime
import decimal
import functools
import hashlib
import io
import itertools
import json
import shutil
import time
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from lakeloom import api
from lakeloom.functions import text as T
from lakeloom.operators import audit as A
from lakeloom.operators import content as C
from lakeloom.operators import governance as G
from lakeloom.operators import ingest as I
from lakeloom.operators import lineage as L
from lakeloom.operators import search as S
from lakeloom.operators import store as V
from lakeloom.operators import textindex as P
from lakeloom.plans import registry
from lakeloom.sources import backends as B
from lakeloom.sources import connectors as K
from lakeloom.streaming import rollups as R


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_redaction(spark):
    got = one(spark, G.redact, "mail user@example.com", "123-45-6789", "key=sk-abcdefghijklmnopqrstuv", "Bearer abc.def", "PROJECT-1234", None)
    assert got == ["mail [REDACTED_EMAIL]", "[REDACTED_SSN]", "key=[REDACTED_API_KEY]", "[REDACTED_BEARER]", "PROJECT-1234", None]
    assert one(spark, lambda c: G.redact(c, ((r"PROJECT-\d+", "[P]"),)), "PROJECT-1234") == ["[P]"]
    assert one(spark, lambda c: G.redact(G.redact(c)), "a@b.cc") == one(spark, G.redact, "a@b.cc")


RULES = [("/open/**", ["*"], ["read", "list"], "allow"), ("/vault/*/k*.pem", ["keeper"], ["all"], "allow"), ("/vault/**", ["*"], ["all"], "deny")]


@pytest.mark.parametrize("path, who, what, effect, reason", [("/open/a/b.md", "bea", "list", "allow", None), ("/open/a", "bea", "delete", "deny", "no matching"), ("/vault/x/k1.pem", "keeper", "write", "allow", None), ("/vault/x/other", "keeper", "write", "deny", "denied by rule (pattern=/vault/**"), ("/else", "bea", "read", "deny", "no matching")])
def test_policy(spark, path, who, what, effect, reason):
    df = spark.createDataFrame([(path, who, what)], "path string, principal string, permission string")
    found = G.evaluate(df, RULES).first()
    assert found["effect"] == effect and (found["reason"] is None if reason is None else found["reason"].startswith(reason) and who in found["reason"])


def test_permissions_and_lineage(spark):
    paths = spark.createDataFrame([("/open/x",), ("/vault/y/k.pem",), ("/z",)], "path string")
    assert {r["path"]: r["allowed"] for r in G.allowed_permissions(paths, "keeper", RULES).collect()} == {"/open/x": ["read", "list"], "/vault/y/k.pem": ["read", "write", "delete", "list"], "/z": []}
    writes = spark.createDataFrame([("/vault/a/k9.pem", ["/open/1", "/vault/b/k.pem"]), ("/vault/a/k8.pem", ["/open/1", "/z", "/vault/q"]), ("/open/o", []), ("/vault/a/k7.pem", [])], "sink string, sources array<string>")
    got = {r["sink"]: (r["effect"], r["reason"]) for r in G.lineage_constraint(writes, "keeper", RULES).collect()}
    assert got["/vault/a/k9.pem"] == ("allow", None) and got["/vault/a/k7.pem"] == ("allow", None) and got["/open/o"][0] == "deny"
    assert got["/vault/a/k8.pem"][0] == "deny" and "path=/z" in got["/vault/a/k8.pem"][1]


def test_policy_files(spark, tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("version: '1'\nrules:\n- path_pattern: /a/**\n  principals: ['*']\n  permissions: [read]\n  effect: allow\n")
    assert G.load_policy(spark, str(path)) == [("/a/**", ["*"], ["read"], "allow")]
    path.write_text("rules:\n- path_pattern: /a\n  principals: ['*']\n  permissions: [fly]\n  effect: allow\n")
    with pytest.raises(ValueError):
        G.load_policy(spark, str(path))
    path.write_text("#" * (G.POLICY_BYTES + 1))
    with pytest.raises(ValueError, match="too large"):
        G.load_policy(spark, str(path))
    path.write_text(json.dumps({"rules": [dict(path_pattern="/a", principals=["*"], permissions=["read"], effect="deny")] * (G.POLICY_RULES + 1)}))
    with pytest.raises(ValueError, match="too"):
        G.load_policy(spark, str(path))


@pytest.mark.parametrize("pattern, path, hit", [("ab*ba", "/aba", True), ("/x/ab*ba", "/x/ab/ba", False), ("/a*b*", "/axb*", True), ("/a*b*", "/axbc", False), ("/**/z", "/z", True), ("*", "/a/b", True), ("/a/*", "/a/b", True), ("/a/*", "/a/b/c", False), ("/a/**", "/a", True), ("/a/**/z", "/a/b/c/z", True), ("/a/x*y", "/a/xy", True), ("/a/x*y", "/a/xzy", True), ("/a.b", "/axb", False)])
def test_globs(spark, pattern, path, hit):
    assert one(spark, lambda c: c.rlike(G.glob_regex(pattern)), path) == [hit]


def test_lineage_with_circles(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "c", "d"), (4, "c", "d")], "id int, source_hash string, sink_hash string")
    ids = lambda depth, up: {r["id"] for r in L.reach(e, "d" if up else "a", depth, up).collect()}
    assert [ids(k, True) for k in range(5)] == [set(), {4}, {4, 2}, {4, 2, 1}, {4, 2, 1, 3}]
    assert ids(1, False) == {1} and ids(9, False) == {1, 2, 3, 4}
    assert L.reach(e, "d", 9).count() == 4


def test_sampling(spark):
    e = spark.range(5000).toDF("id")
    assert L.sampled(e, 0.0).count() == 0 and L.sampled(e, 1.0).count() == 5000 and L.sampled(e, 0.125).count() == 625


def test_cosine_and_upsert(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.0, 0.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [tuple(r) for r in S.vector_topk(v, q, 10).select("vec_id", "score").collect()] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert S.upsert(v, v.filter("vec_id = 1"), "vec_id").count() == 4


def found(index, query, **kw):
    return {r["doc_id"] for r in P.search(index, query, **kw).collect()}


def test_queries(spark):
    rows = [(1, "/a.md", "h1", "red green blue"), (2, "/b.md", "h2", "green red, red again"), (3, "/c.md", "h3", "Blue <b>red</b> green"), (4, "/d.md", "h4", None)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, hash string, text string")
    i = P.build(docs)
    assert found(i, "blue") == {1} and found(i, "blue Blue") == {1, 3} and found(i, '"red green"') == {1} and found(i, '"green red red"') == {2}
    assert found(i, "+red -blue") == {2, 3} and found(i, "red AND NOT Blue") == {1, 2} and found(i, "(blue OR Blue) AND red") == {1, 3}
    assert found(i, "path:/b.md") == {2} and found(i, "/b.md") == {2} and found(i, "-red") == set() and found(i, "nothing") == set() and found(i, "") == set()
    assert found(i, "text:/b.md") == set() and found(P.build(docs, lowercase=True), "BLUE", lowercase=True) == {1, 3}
    best = P.hits(i, docs, "red").collect()
    assert best[0]["doc_id"] == 2 and best[0]["path"] == "/b.md" and {r["doc_id"]: r["snippet"] for r in best}[3] == "Blue red green"
    assert found(P.upsert(i, docs.filter("doc_id = 1").withColumn("text", F.lit("grey"))), "red") == {2, 3}
    assert found(P.delete(i, docs.filter("doc_id = 2")), "red") == {1, 3}
    for bad in ("(red", "red)", "AND red", '+"', "red OR"):
        with pytest.raises(ValueError):
            P.search(i, bad) if bad != "red OR" else P.parse("red AND")


def test_hybrid_limits(spark):
    t = spark.createDataFrame([(1, 2.0), (2, 1.0)], "doc_id long, score double")
    assert S.hybrid(t, t, 0.5, 0).count() == 0 and S.hybrid(t, t.limit(0), 7.0, 5).collect()[0]["score"] == 0.0


def test_contents(spark):
    f = spark.createDataFrame([("/a", bytearray(b"0123456789")), ("/b", bytearray()), ("/ab", bytearray("é".encode()))], "path string, data binary")
    assert [(r["pos"], r["length"]) for r in V.chunk_rows(f, 4).filter("path = '/a'").orderBy("pos").collect()] == [(0, 4), (1, 4), (2, 2)]
    m = V.manifests(f, 4)
    assert {r["path"]: r["size"] for r in m.collect()} == {"/a": 10, "/b": 0, "/ab": 2}
    chunks = V.chunk_rows(f, 4).select("hash", "data")
    back = {r["path"]: (bytes(r["data"]), r["n_bad"]) for r in V.read_files(m, chunks).collect()}
    assert back == {"/a": (b"0123456789", 0), "/b": (b"", 0), "/ab": ("é".encode(), 0)}
    lost = chunks.filter(F.col("data") != F.lit("4567").cast("binary"))
    assert {r["path"]: (bytes(r["data"]), r["n_bad"]) for r in V.read_files(m, lost).collect()}["/a"] == (b"012389", 1)
    parts = f.filter("path = '/a'").select(*[V.byte_range(F.col("data"), F.lit(o), F.lit(n)) for o, n in ((2, 3), (8, 9), (99, 1), (4, -1), (-3, 2))]).first()
    assert [bytes(x) for x in parts] == [b"234", b"89", b"", b"456789", b"01"]


def trees(spark, **files):
    rows = [(t, p, h, "file") for t, f in files.items() for p, h in f.items()]
    return V.merkle(spark.createDataFrame(rows, "tree string, path string, object_hash string, kind string"))


def test_trees(spark):
    e = trees(spark, a={"/x/1": "p", "/x/2": "q", "/y/z/3": "r", "/f": "s"}, b={"/x/1": "p", "/x/2": "q", "/y/z/3": "R", "/f/in": "t", "/n/4": "u"}, c={"/q/1": "p", "/q/2": "q"}).cache()
    root = lambda t: V.roots(e).filter(F.col("tree") == t).select(F.col("dir_hash").alias("hash"))
    diff = lambda a, b: [(r["op"], r["path"]) for r in V.diff_trees(e, root(a), root(b)).collect()]
    assert diff("a", "a") == [] and diff("a", "b") == [("mod", "/f"), ("add", "/n/4"), ("mod", "/y/z/3")]
    flip = {"add": "del", "del": "add", "mod": "mod"}
    assert sorted((flip[o], p) for o, p in diff("b", "a")) == sorted(diff("a", "b"))
    dirs = {(r["tree"], r["path"]): r["dir_hash"] for r in e.collect()}
    assert dirs["a", "/x"] == dirs["b", "/x"] == dirs["c", "/q"] and dirs["a", "/y"] != dirs["b", "/y"]  # equal subtrees are one object
    assert {r["path"] for r in V.listing(e, root("a")).collect()} == {"/x", "/x/1", "/x/2", "/y", "/y/z", "/y/z/3", "/f"}
    assert V.resolve(e, root("a"), "/y/z/3").first()["hash"] == "r" and V.resolve(e, root("a"), "/y/none").count() == 0 and V.resolve(e, root("a"), "/f/x").count() == 0
    assert {r["hash"] for r in V.walk(e, root("a").union(root("c"))).filter("kind = 'file'").collect()} == set("pqrs")


def test_commits(spark):
    c = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a"]), ("d", ["b", "c"]), ("e", ["x"]), ("l", ["m"]), ("m", ["l"])], "hash string, parents array<string>")
    heads = lambda *h: spark.createDataFrame([("k", x) for x in h], "branch string, hash string")
    reach = lambda *h: {r[0] for r in V.reachable(c, heads(*h)).collect()}
    assert reach("d") == set("abcd") and reach("e") == {"e"} and reach("l") == {"l", "m"} and reach("none") == set()
    log = lambda h, n: [r["hash"] for r in V.first_parent_log(c, heads(h), n).orderBy("depth").collect()]
    assert log("d", 9) == ["d", "b", "a"] and log("d", 2) == ["d", "b"] and log("l", 4) == ["l", "m", "l", "m"] and log("d", 0) == []


def test_refcounts_and_sweep(spark):
    chunk = "array<struct<hash:string,length:int>>"
    m = spark.createDataFrame([("f1", "b1", [("c1", 1), ("c1", 1), ("c2", 1)]), ("f2", "b2", [("c2", 1)]), ("f1", "b1", [("c1", 1), ("c1", 1), ("c2", 1)]), ("f3", "b3", [("c3", 1)])], f"file_hash string, blob_hash string, chunks {chunk}")
    objects = spark.createDataFrame([("f1", "file"), ("f2", "file"), ("t", "dir")], "hash string, kind string")
    live = V.live_chunks(objects, m, m)
    assert dict(map(tuple, live.collect())) == {"c1": 2, "c2": 2}
    all_ = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c9",)], "hash string")
    stay, swept = V.sweep(all_, live)
    assert {r[0] for r in swept.collect()} == {"c3", "c9"} and stay.count() == 2 and V.sweep(all_, live, dry_run=True)[0].count() == 4


def test_snapshots(spark):
    h = spark.createDataFrame([("/a", "1"), ("/ab", "2"), ("/a2/x", "3")], "path string, hash string")
    paths = lambda df: {r["path"] for r in df.collect()}
    assert paths(C.rename(h, "/a", "/ab")) == {"/ab", "/a2/x"} and paths(C.rename(h, "/a2", "/new/")) == {"/a", "/ab", "/new/x"}
    assert paths(C.fork(h, "/a2", "/c")) == {"/a", "/ab", "/a2/x", "/c/x"}
    long = "/a2/" + "y" * (1 << 20) + "tail"
    deep = spark.createDataFrame([(long, "1")], "path string, hash string")
    assert paths(C.rename(deep, "/a2", "/b")) == {long.replace("/a2", "/b", 1)}
    assert C.diff(h, h).count() == 0 and {(r["op"], r["path"]) for r in C.diff(h, C.fork(h, "/a", "/c")).collect()} == {("add", "/c")}
    t = spark.createDataFrame([("k", "v")], "key string, value string")
    with pytest.raises(ValueError):
        V.apply_batch(t, spark.createDataFrame([(0, "put", "a", "b"), (1, "burn", "k", None)], "ord int, op string, key string, value string"))


def test_backends(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k:02x}" * 32, bytearray([k])) for k in range(5)] * 2, "hash string, data binary")
    for backend in (B.TableBackend(spark), B.FolderBackend(spark, f"file://{tmp_path}/chunks")):
        assert backend.all().count() == 0 and not backend.get(["00" * 32]).first()["there"]
        backend.put(rows)
        backend.put(rows)
        assert backend.all().count() == 5
        backend.delete(rows.filter(F.col("hash").startswith("03")).union(spark.createDataFrame([("ff" * 32, bytearray())], "hash string, data binary")))
        got = {r["hash"][:2]: (r["there"], r["size"]) for r in backend.get(["03" * 32, "04" * 32]).collect()}
        assert got == {"03": (False, None), "04": (True, 1)} and backend.all().count() == 4


def test_bundles(spark, tmp_path):
    rows = spark.createDataFrame([(__import__("hashlib").sha256(bytes([k]) * 99).hexdigest(), bytearray(bytes([k]) * 99)) for k in range(9)], "hash string, data binary")
    m = V.export_bundle(rows, f"file://{tmp_path}/b", "c1", known=rows.limit(2)).first()
    assert (m["chunk_count"], m["byte_count"]) == (7, 7 * 99) and V.verify_bundle(spark, f"file://{tmp_path}/b").first() == (7, 0, True)
    assert V.export_bundle(rows.limit(0), f"file://{tmp_path}/none", "c0").first()["chunk_count"] == 0
    rows.limit(1).write.mode("append").parquet(f"file://{tmp_path}/b/chunks")
    assert not V.verify_bundle(spark, f"file://{tmp_path}/b").first()["sealed"]


def test_ingest(spark):
    f = spark.createDataFrame([("/a.txt", bytearray(b"one three"), {"k": "v"}), ("/b.json", bytearray(b'{"a": "bad"}'), {}), ("/c.png", bytearray(b"x"), None), ("/d.txt", None, {})], "path string, content binary, xattrs map<string,string>")

    def embedder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return [[float(len(t))] for t in texts]

    got = {r["path"]: (r["text"], r["embedding"], r["model_version"]) for r in I.ingest(f.repartition(4, "path"), I.deny_list(("k", "w")), embedder, "m1").collect()}
    assert got["/a.txt"] == ("one three", [9.0], "m1") and got["/b.json"] == ("a bad", [], "") and got["/c.png"][0] == "" and got["/d.txt"][0] == ""
    assert I.ingest(f, I.deny_list(("k", "v"))).count() == 3 and I.ingest(f, I.allow_all()).filter("size(embedding) > 0").count() == 0


def test_placement_and_quota(spark):
    c = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, 30, 2), (4, 0, 3)], "id int, free long, rack int")
    hashes = [f"{k:064x}" for k in (0, 9 << 128, 10 << 128, 29 << 128, 30 << 128, 59 << 128, 60 << 128)]
    o = spark.createDataFrame([(h,) for h in hashes], "hash string")

    def pick(by, **kw):
        return {r["hash"]: r["replicas"] for r in G.replicas(o, by, 3, **kw).collect()}

    assert [pick(c)[h][0] for h in hashes] == [1, 1, 2, 2, 3, 3, 1]  # sixteen bytes, the last of which counts once
    assert pick(c)[hashes[0]] == [1, 3, 4] and pick(c, rack_aware=False)[hashes[0]] == [1, 2, 3] and pick(c)[hashes[4]] == [3, 4, 1]
    assert pick(c, primary=G.round_robin)[hashes[1]][0] == 1 and pick(c.withColumn("free", F.lit(0).cast("long")))[hashes[0]][0] == 1
    assert pick(c.limit(0))[hashes[0]] == []

    q = spark.createDataFrame([(100, 200, True), (920, 930, True), (950, 1050, True), (0, 0, False)], "used long, after long, known boolean")
    assert [r[0] for r in q.select(G.quota_decision(F.col("after"), F.col("used"), F.lit(1000), F.col("known"))).collect()] == ["allow", "throttle", "deny", "deny"]


def _mixed(h, n):
    return functools.reduce(lambda a, b: a * 131 + b, bytes.fromhex(h)[:n], 0)


def test_placement_among_many_chains(spark):
    start = time.monotonic()
    free = [0 if k % 3 == 0 else (1 << 64) - 1 if k % 1000 == 1 else k * 7919 % 100_003 for k in range(4001)]
    c = spark.createDataFrame([(k, decimal.Decimal(f)) for k, f in enumerate(free)], "id int, free decimal(38,0)").withColumn("rack", F.col("id") % 7).repartition(5)
    hashes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(3000)]
    o = spark.createDataFrame([(h,) for h in [*hashes, None]], "hash string")
    ends = list(itertools.accumulate(free))
    got = dict(map(tuple, G.replicas(o, c, 2, rack_aware=False).collect()))
    first = {h: bisect.bisect_right(ends, _mixed(h, 16) % ends[-1]) for h in hashes}
    assert got == {h: [p, (p + 1) % 4001] for h, p in first.items()} | {None: None}
    got = dict(map(tuple, G.replicas(o, c, 1, primary=G.round_robin, rack_aware=False).collect()))
    assert got == {h: [_mixed(h, 8) % 4001] for h in hashes} | {None: None}
    assert time.monotonic() - start < 60  # the chains aren't walked once an object, which took minutes


def _placed(spark, folder, name):
    """What differs between a placement query and its SQL, with a document that stands twice and one without a text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(None).cast("string")})
    docs.union(docs.filter("doc_id < 3")).union(odd).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").filter("s_suppkey <= 300").write.parquet(f"{folder}/supplier.parquet")
    con = duckdb.connect()
    for t in ("documents", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return oracle.same(registry.queries()[name](spark, str(folder)), con, registry.oracle_sql()[name])


def test_placement_of_odd_documents(spark, tmp_path):
    assert _placed(spark, tmp_path, "placement_capacity") == ""


def test_replicas_on_racks(spark):
    start = time.monotonic()
    racks = [None if k % 50 == 7 else k // 200 % 9 for k in range(3000)] + [k % 11 for k in range(1000)]
    c = spark.createDataFrame([(f"c{k:05}", 1 + k % 5, r) for k, r in enumerate(racks)], "id string, free long, rack int").repartition(5)
    o = spark.createDataFrame([(hashlib.sha256(str(k).encode()).hexdigest(),) for k in range(2000)], "hash string")
    ends = list(itertools.accumulate(1 + k % 5 for k in range(4000)))
    for n in (1, 5, 12, 20):
        for h, got in G.replicas(o, c, n).collect():
            p = bisect.bisect_right(ends, _mixed(h, 16) % ends[-1])
            seen, first, rest = set(), [], []
            for x in ((p + k) % 4000 for k in range(4000)):
                (rest if racks[x] in seen else first).append(x)
                seen.add(racks[x])
                if len(first) >= n or len(seen) == 12 and len(first) + len(rest) >= n:
                    break
            assert got == [f"c{x:05}" for x in (first + rest)[:n]]
    few = [(1, 1, 1), (2, 1, None), (3, 1, 1), (4, 1, None)]
    got = G.replicas(o.limit(1).select(F.lit("0" * 64).alias("hash")), spark.createDataFrame(few, "id int, free long, rack int"), 9).first()
    assert got["replicas"] == [1, 2, 3, 4]  # those without a rack share one, and none is left out
    assert time.monotonic() - start < 90


def test_replicas_of_odd_documents(spark, tmp_path):
    assert _placed(spark, tmp_path, "placement_rack_aware") == ""


def test_formats():
    def archive(name, xml):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, xml)
        return b.getvalue()

    assert T.office_text(archive("word/document.xml", "<d><t>Hello</t><t>world</t></d>")) == "Hello world"
    assert T.office_text(archive("ppt/slides/slide1.xml", "<d><t>Slide</t></d>")) == "Slide" and T.office_text(b"junk") == ""
    assert T.pdf_text(b"stream BT (Hello \\(PDF\\)) Tj <576F726C64> Tj ET endstream") == "Hello (PDF) World"
    head = json.dumps({"bias": {"dtype": "I8", "shape": [3], "data_offsets": [0, 3]}, "__metadata__": {"by": "us"}}).encode()
    data = len(head).to_bytes(8, "little") + head + bytes(3)
    assert T.tensor_header(data) == [("bias", "I8", [3], 8 + len(head), 11 + len(head))]
    assert T.identifier_strings(b"\0\0\0\3abc\0\0\0\1\xff\0\0\0\2x y") == "abc x" and T.parquet_names(b"PAR1junk") == T.arrow_names(b"ARROW1junk") == ""
    assert T.extract_jsonl('{"a": "x"}\nbad\n{"b": ["y", 1]}') == "a x b y"


def test_extraction(spark):
    assert one(spark, T.extract_json, '{"b": {"c": "v"}, "a": ["x", 2, null]}', "no json") == ["a x b c v", "no json"]
    assert one(spark, T.extension, "/a/b.TXT?x=1", "/a.b/c", "x.tar.gz") == ["txt", "", "gz"]
    assert one(spark, lambda c: T.looks_like_text(c.cast("binary")), "plain", "", "\x01\x02\x03a") == [True, False, False]
    assert one(spark, T.csv_cells, "a, b\n,c") == ["a b c"] and one(spark, C.normal_path, "/a//b/", "a/b", "/a/../b") == ["/a/b", None, None]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.stream_rollup(stream, late="90 days").writeStream.outputMode("complete").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, R.stream_rollup(events).collect()))
    q = stream.select("user_id", "event_id").writeStream.foreachBatch(R.upsert_into(str(tmp_path / "up"), "user_id")).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    last = R.read_upserted(spark, str(tmp_path / "up"), "user_id long, event_id long")
    assert last.count() == events.select("user_id").distinct().count() == last.select("user_id").distinct().count()
    newest = R.upsert_into(str(tmp_path / "one"), "k", "v")
    for epoch, rows in enumerate(([(1, 5), (2, 1)], [(1, 3), (3, 9)], [(2, 7)])):
        for _ in range(2):  # a batch may be run again
            newest(spark.createDataFrame(rows, "k long, v long"), epoch)
    assert sorted(map(tuple, R.read_upserted(spark, str(tmp_path / "one"), "k long, v long").collect())) == [(1, 5), (2, 7), (3, 9)]


def test_sources(spark, tmp_path):
    assert K.parse_source("s3://b/x/y") == K.Source("s3", "b", "x/y") and K.parse_source("gcs://b") == K.Source("gcs", "b", "")
    assert K.parse_source("git-lfs://host/r#dev").path == "dev" and K.parse_source("git-lfs://host/r").path == "main"
    assert K.parse_source("/a/b") == K.parse_source("file:///a/b") == K.Source("file", "/", "/a/b")
    with pytest.raises(ValueError):
        K.parse_source("ftp://x")
    for n in "cab":
        (tmp_path / f"{n}.bin").write_bytes(n.encode() * 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.bin").write_bytes(b"d")
    assert [tuple(r) for r in K.list_files(spark, str(tmp_path)).select("name", "size").collect()] == [("a.bin", 3), ("b.bin", 3), ("c.bin", 3)]
    assert K.list_files(spark, str(tmp_path), 2).count() == 2 and bytes(K.fetch(spark, str(tmp_path / "c.bin")).first()["content"]) == b"ccc"
    K.append_jsonl(spark.range(3), str(tmp_path / "log"))
    K.append_jsonl(spark.range(3, 5), str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text('{"id": 9}\n\n{"id": \nno json\n')
    assert sorted(r[0] for r in K.read_jsonl(spark, str(tmp_path / "log"), "id long").collect()) == [0, 1, 2, 3, 4, 9]


def entries(spark, *logs):
    rows = [(log, k, 1000 + k, "made", f"/s/{k}", 'who "x"', {"b": "2", "a": "é"}) for k, log in enumerate(logs)]
    return spark.createDataFrame(rows, "log long, ord long, ts long, event_type string, subject string, actor string, detail map<string,string>")


def test_sources_that_are_folders(spark, tmp_path):
    for n, size in (("b/part-0", 2), ("b/k=1/part-1", 3), ("a", 1), ("c", 7), ("d/part-0", 6), ("d/_SUCCESS", 4), ("_hidden/part-0", 9)):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * size)
    found = K.list_files(spark, f"{tmp_path}/", folders=True).collect()
    assert [(r["path"], r["name"], r["size"]) for r in found] == [(f"file:{tmp_path}/{n}", n, size) for n, size in (("a", 1), ("b", 5), ("c", 7), ("d", 6))]
    assert [r["name"] for r in K.list_files(spark, str(tmp_path), 2, folders=True).collect()] == ["a", "b"]


def test_tables_that_are_folders(spark, tmp_path):
    """The first tables of a folder in which some are files, and some folders of several files."""
    for n in oracle.TABLES:
        if n in ("conversations", "documents", "embeddings", "labels", "pages"):
            spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").repartition(3).write.parquet(f"{tmp_path}/{n}.parquet")
        else:
            shutil.copy(f"/root/testdata/sf0.001/{n}.parquet", tmp_path)
    q = registry.queries()["source_list_limited"]
    assert oracle.same(q(spark, str(tmp_path)), duckdb.connect(), registry.oracle_sql()["source_list_limited"]) == ""


def test_audit_chains(spark):
    import hashlib

    empty = spark.createDataFrame([], A.ENTRY)
    log = A.append(A.append(empty, entries(spark, 1, 2, 1, 1)), entries(spark, 2, 1)).cache()
    rows = {(r["log"], r["seq"]): r for r in log.collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    prev = "genesis"
    for k in range(4):  # the canonical form, made by another library
        r = rows[1, k]
        said = {"actor": r["actor"], "detail": dict(sorted(r["detail"].items())), "event_type": r["event_type"], "prev_hash": prev, "seq": k, "subject": r["subject"], "ts": r["ts"]}
        prev = hashlib.sha256(json.dumps(said, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert r["hash"] == prev
    valid = lambda df: {r["log"]: r["valid"] for r in A.verify_chain(df).collect()}
    assert valid(log) == {1: True, 2: True} and valid(empty) == {}
    for column in ("ts", "subject", "actor", "event_type", "prev_hash", "hash", "detail"):
        other = {"ts": F.col("ts") + 1, "detail": F.create_map(F.lit("a"), F.lit("z"))}.get(column, F.lit("x"))
        changed = log.withColumn(column, F.when((F.col("log") == 1) & (F.col("seq") == 3), other).otherwise(F.col(column)))
        assert valid(changed) == {1: False, 2: True}, column
    assert valid(log.filter("not (log = 1 and seq = 1)")) == {1: False, 2: True}
    assert {r["log"]: (r["next_seq"], r["prev_hash"]) for r in A.recover(log).collect()}[1] == (4, prev)


def test_borders_of_blocks_in_a_log(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 2)
    log = A.append(spark.createDataFrame([], A.ENTRY), entries(spark, *[5] * 9))
    assert A.verify_chain(log).first()["valid"] and not A.verify_chain(log.filter("seq not in (4, 5)")).first()["valid"]


def test_schedules():
    at = datetime.datetime(2024, 2, 28, 23, 59, 30)
    assert G.next_run({"interval_secs": 3600}, at) == datetime.datetime(2024, 2, 29, 0, 59, 30) and G.next_run({}, at) is None
    assert G.next_run({"cron": "0 2 * * *"}, at) == datetime.datetime(2024, 2, 29, 2, 0)
    assert G.next_run({"cron": "30 4 29 2 *"}, at.replace(month=3)) == datetime.datetime(2028, 2, 29, 4, 30)
    assert G.next_run({"cron": "0,30 * * * 0"}, at) == datetime.datetime(2024, 3, 3, 0, 0)
    for bad in ("* * *", "0 0 31 2 *", "x * * * *"):
        with pytest.raises(ValueError):
            G.next_run({"cron": bad}, at)


def test_engine(spark):
    seen = []

    def hook(path, data):
        if data == b"no":
            raise PermissionError("not this")
        seen.append(path)

    def door(who, path, permission):
        if who == "mallory":
            raise PermissionError("who are you")

    e = api.Engine(spark, subtree="/home", write_hooks=(hook,), auth_hooks=(door,))
    e.write("/home/a/b", b"1")
    assert e.stat("/home/a")["kind"] == "dir" and [x["path"] for x in e.list("/home")] == ["/home/a"] and e.read("/home/a/b") == b"1" and seen == ["/home/a/b"]
    first = e.commit("n", "n@x", "one")
    e.rename("/home/a", "/home/c")
    e.mkdir("/home/empty")
    second = e.commit("n", "n@x", "two")
    assert e.diff(first, second) == [{"op": "del", "path": "/home/a/b"}, {"op": "add", "path": "/home/c/b"}] or e.diff(first, second) == [{"op": "add", "path": "/home/c/b"}, {"op": "del", "path": "/home/a/b"}]
    assert [c["message"] for c in e.log()] == ["two", "one"] and e.branch("dev") == {"main": second, "dev": second}
    e.checkout(first)
    assert e.read("/home/a/b") == b"1" and e.head[0] == "detached"
    for call, error in (
        (lambda: e.commit("n", "n@x", "three"), api.InvalidArgument),
        (lambda: e.write("/home/a", b"x"), api.InvalidArgument),
        (lambda: e.write("/home/a/b/c", b"x"), api.InvalidArgument),
        (lambda: e.write("/home/x", b"no"), api.Forbidden),
        (lambda: e.delete("/"), api.InvalidArgument),
        (lambda: e.delete("/home/zz"), api.NotFound),
        (lambda: e.mkdir("/home/a/b"), api.InvalidArgument),
        (lambda: e.branch_delete("nope"), api.NotFound),
        (lambda: e.invoke("bea", "fs.stat", {"path": "/other"}), api.Forbidden),
        (lambda: e.invoke("bea", "fs.stat", {"path": "/homely"}), api.Forbidden),
        (lambda: e.invoke("mallory", "fs.stat", {"path": "/home/a"}), api.Forbidden),
        (lambda: e.invoke("bea", "policy.show", {"path": "/"}), api.Unsupported),
        (lambda: e.invoke("bea", "semantic.embed", {"path": "/home/a/b"}), api.Unsupported),
    ):
        with pytest.raises(error):
            call()
    e.branch_delete("dev")
    e.embedder = I.length_counts
    assert e.invoke("bea", "semantic.embed", {"path": "/home/a/b"})["embedding"] == [0.0, 1.0, 0.0, 0.0]
    assert A.verify_chain(e.audit_log()).first()["valid"] and e.audit_log().count() == 6
    assert api.parse_capability("x.fs.read_text") == "fs_read_text" == api.parse_capability("fs_read_text") and api.parse_capability("fs.") is None
    assert len(api.catalog()) == 31


def test_engine_search(spark):
    files = spark.createDataFrame([("/a", bytearray(b"ann@x.org likes tea")), ("/b", bytearray(b"tea, tea"))], "path string, data binary")
    docs = files.select(F.hash("path").cast("long").alias("doc_id"), "path", F.sha2("data", 256).alias("hash"), F.col("data").cast("string").alias("text"))
    e = api.Engine(spark, files=files, redact=True, index=P.build(docs))
    got = e.invoke("bea", "semantic.query", {"q": "tea"})
    assert [x["path"] for x in got] == ["/b", "/a"] and "[REDACTED_EMAIL]" in got[1]["snippet"]


def test_zarr_and_limits(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a/.zarray", '{"dtype": "<f4"}')
        z.writestr("a/0.0", "chunk")
    assert T.zarr_text(b.getvalue()) == "dtype <f4" and T.zarr_text(b'{"zarr_format": 3}') == "zarr_format" and T.zarr_text(b"PKjunk") == "" and T.zarr_text(b"") == ""
    assert spark.range(1).select(G.bytes_fraction(F.lit(3), F.lit(0)), G.bytes_fraction(F.lit(3), F.lit(6))).first() == (0.0, 0.5)
    assert one(spark, lambda c: T.utf8(F.unhex(c)), "41FF42") == ["A\ufffdB"]
