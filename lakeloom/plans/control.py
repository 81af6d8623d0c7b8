"""Queries on policies, audit logs, quotas, compliance, placement and tuning."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakeloom.functions.text import hmac_sha256
from lakeloom.operators import audit as A
from lakeloom.operators import governance as G
from lakeloom.plans.registry import FILES, TENANTS, files, query
from lakeloom.sources import connectors as K
from lakeloom.sources import fixtures as X

# Policies ------------------------------------------------------------------------------------------------------------
ALICE, ADMIN, ALICE_ADMIN = "('alice')", "('admin')", "('alice'), ('admin')"
READ, LIST, READ_WRITE, ALL_PERMISSIONS = "('read', 0)", "('list', 0)", "('read', 0), ('write', 1)", "('read', 0), ('write', 1), ('delete', 2), ('list', 3)"
RULES = [("/src1/**", ["*"], ["read", "list"], "allow"), ("/src2/**", ["admin"], ["all"], "allow"), ("/src2/**", ["*"], ["all"], "deny"), ("/src3/*/1*.txt", ["*"], ["read"], "allow"), ("/src4/**", ["alice"], ["read", "write"], "allow")]


def _policy(principals: str, permissions: str, paths: str = "SELECT path FROM files") -> str:
    tail = "||' principal='||principal||' perm='||permission||')'"
    rule = "CASE WHEN starts_with(path, '/src1/') AND permission IN ('read', 'list') THEN 1 WHEN starts_with(path, '/src2/') AND principal = 'admin' THEN 2 WHEN starts_with(path, '/src2/') THEN 3 WHEN regexp_matches(path, '^/src3/[^/]*/1[^/]*\\.txt$') AND permission = 'read' THEN 4 WHEN starts_with(path, '/src4/') AND principal = 'alice' AND permission IN ('read', 'write') THEN 5 ELSE 0 END"
    return f"{FILES}, p AS (SELECT * FROM (VALUES {principals}) t(principal)), q AS (SELECT * FROM (VALUES {permissions}) t(permission, ord)), w AS ({paths}), r AS (SELECT path, principal, permission, ord, {rule} AS rule FROM w, p, q), ev AS (SELECT path, principal, permission, ord, CASE WHEN rule IN (0, 3) THEN 'deny' ELSE 'allow' END AS effect, CASE rule WHEN 0 THEN 'no matching allow rule (path='||path{tail} WHEN 3 THEN 'denied by rule (pattern=/src2/**'{tail} END AS reason FROM r)"


def _requests(s, d, principals, permissions):
    each = F.explode(F.array(*map(F.lit, principals)))
    return files(s, d).select("path", each.alias("principal")).select("path", "principal", F.explode(F.array(*map(F.lit, permissions))).alias("permission"))


@query(f"WITH {_policy(ALICE_ADMIN, READ_WRITE)} SELECT path, principal, permission, effect, reason FROM ev")
def policy_evaluate(s, d):
    return G.evaluate(_requests(s, d, ["alice", "admin"], ["read", "write"]), RULES)


@query(f"WITH {_policy(ALICE, ALL_PERMISSIONS)} SELECT path, coalesce(string_agg(CASE WHEN effect = 'allow' THEN permission END, ',' ORDER BY ord), '') AS allowed FROM ev GROUP BY 1")
def policy_show(s, d):
    return G.allowed_permissions(files(s, d), "alice", RULES).select("path", F.array_join("allowed", ",").alias("allowed"))


@query(f"WITH {_policy(ADMIN, LIST)} SELECT path, effect, reason FROM ev")
def policy_check(s, d):
    return G.evaluate(_requests(s, d, ["admin"], ["list"]), RULES).select("path", "effect", "reason")


@query(f"WITH {_policy(ALICE, READ_WRITE)}, k AS (SELECT path AS sink, CAST(regexp_extract(path, '(\\d+)\\.txt$', 1) AS BIGINT) AS id FROM files), f AS (SELECT doc_id, path FROM files), u AS (SELECT sink, 0 AS k, f.path FROM k JOIN f ON f.doc_id = k.id - 1 UNION ALL SELECT sink, 1, f.path FROM k JOIN f ON f.doc_id = k.id - 2), b AS (SELECT sink, arg_min(reason, k) AS blocked FROM u JOIN ev ON ev.path = u.path AND ev.permission = 'read' WHERE effect = 'deny' GROUP BY 1) SELECT e.path AS sink, CASE WHEN blocked IS NOT NULL THEN 'deny' ELSE effect END AS effect, CASE WHEN blocked IS NOT NULL THEN 'lineage constraint: write to '||e.path||' blocked - '||blocked ELSE reason END AS reason FROM ev e LEFT JOIN b ON e.path = b.sink WHERE e.permission = 'write'")
def policy_lineage_constraint(s, d):
    """Each file as a sink whose sources are the two files before it."""
    f = files(s, d).select("doc_id", "path")
    source = lambda n: f.select((F.col("doc_id") + n).alias("doc_id"), F.struct(F.lit(n).alias("n"), F.col("path")).alias("s"))
    near = source(1).union(source(2)).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("l"))
    writes = f.join(near, "doc_id", "left").select(F.col("path").alias("sink"), F.coalesce(F.transform("l", lambda x: x["path"]), F.array().cast("array<string>")).alias("sources"))
    return G.lineage_constraint(writes, "alice", RULES)


@query(f"WITH {_policy(ALICE, READ)} SELECT path, effect FROM ev")
def policy_file(s, d):
    """Requests under rules that were read from a file."""
    said = {"version": "1", "rules": [dict(zip(("path_pattern", "principals", "permissions", "effect"), r, strict=True)) for r in RULES]}
    path = K.scratch(s, "policy")
    s.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(path)
    rules = G.load_policy(s, path)
    return G.evaluate(_requests(s, d, ["alice"], ["read"]), rules).select("path", "effect")


@query(f"WITH {FILES} SELECT path, starts_with(path, '/src1/') AS inside, starts_with(path, '/src1') AS raw FROM files")
def scope_filter(s, d):
    """Paths within a subtree by whole segments, and by its characters alone."""
    path = F.col("path")
    return files(s, d).select("path", G.in_scope(path, "/src1").alias("inside"), G.in_scope(path, "src1", raw=True).alias("raw"))


_TOKEN_KEY = b"signing key of the store"
_PADS = ["".join(f"{b ^ x:02X}" for b in _TOKEN_KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f"WITH t AS (SELECT c_custkey AS id, c_name, c_custkey * 100 AS expires_at, c_custkey||'|'||c_name||'|'||c_custkey * 100 AS body FROM customer), m AS (SELECT *, sha256(unhex('{_PADS[1]}')||unhex(sha256(unhex('{_PADS[0]}')||encode(body)))) AS signature FROM t) SELECT id, signature, CASE WHEN id % 7 = 0 THEN 'revoked' WHEN 5000 > expires_at + 30 THEN 'expired' WHEN id % 13 = 0 THEN 'bad signature' ELSE 'ok' END AS state FROM m")
def token_valid(s, d):
    """Tokens with a signature over their fields: some are revoked, some too old, and some were changed after they were signed."""
    c = X.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("principal"), (F.col("c_custkey") * 100).alias("expires_at"))
    body = lambda who: F.concat_ws("|", F.col("id").cast("string"), who, F.col("expires_at").cast("string")).cast("binary")
    c = c.withColumn("signature", hmac_sha256(_TOKEN_KEY, body(F.col("principal"))))
    said = F.when(F.col("id") % 13 == 0, F.concat("principal", F.lit("!"))).otherwise(F.col("principal"))
    revoked = c.filter("id % 7 = 0").select("id", F.lit(True).alias("revoked"))
    j = c.withColumn("principal", said).join(revoked, "id", "left")
    signed = F.col("signature") == hmac_sha256(_TOKEN_KEY, body(F.col("principal")))
    return j.select("id", "signature", G.token_state(F.lit(5000), F.col("expires_at"), F.coalesce("revoked", F.lit(False)), signed).alias("state"))


# Audit ---------------------------------------------------------------------------------------------------------------
def _json(prev: str) -> str:
    return f"""sha256('{{"actor":"'||actor||'","detail":{{"n":"'||n||'"}},"event_type":"'||event_type||'","prev_hash":"'||{prev}||'","seq":'||seq||',"subject":"'||subject||'","ts":'||ts||'}}')"""


_ENTRIES = "en AS (SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_id % 10 = 9 AS INT), event_id) - 1 AS seq, (epoch_us(ts) // 1000) AS ts, event_type, '/e/'||event_id AS subject, 'u'||user_id AS actor, event_id AS n, event_id % 10 = 9 AS new FROM events)"
CHAIN = f"{_ENTRIES}, ch AS (SELECT log, seq, {_json(chr(39) + 'genesis' + chr(39))} AS hash, 'genesis' AS prev_hash FROM en WHERE seq = 0 UNION ALL SELECT en.log, en.seq, {_json('ch.hash').replace('||seq||', '||en.seq||')}, ch.hash FROM ch JOIN en ON en.log = ch.log AND en.seq = ch.seq + 1), au AS (SELECT en.*, ch.hash, ch.prev_hash FROM en JOIN ch ON en.log = ch.log AND en.seq = ch.seq)"


def _new(s, d):
    """New entries for a log of each user: ord, ts, event_type, subject, actor, detail; and whether they come second."""
    e = X.table(s, d, "events")
    number = F.col("event_id").cast("string")
    return e.select(F.col("user_id").alias("log"), F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_type", F.concat(F.lit("/e/"), number).alias("subject"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.create_map(F.lit("n"), number).alias("detail"))


def _log(s, d):
    """The logs before the second part of the entries is appended."""
    return A.append(s.createDataFrame([], A.ENTRY), _new(s, d).filter("ord % 10 <> 9"))


_SHOWN = ["log", "seq", "ts", "event_type", "subject", "actor", "hash", "prev_hash"]


@query(f"WITH RECURSIVE {CHAIN} SELECT {', '.join(_SHOWN)} FROM au")
def audit_append(s, d):
    """The whole logs after entries are appended to those that are there."""
    from lakeloom.operators.store import written

    return A.append(written(_log(s, d), "audit"), _new(s, d).filter("ord % 10 = 9")).select(*_SHOWN)


@query(f"WITH RECURSIVE {CHAIN}, k AS (SELECT log, count(*) AS n FROM au WHERE NOT new GROUP BY 1) SELECT log, CASE WHEN log % 3 = 1 AND n > 1 THEN n - 1 ELSE n END AS entries, CASE WHEN log % 3 = 0 AND n > 2 THEN false WHEN log % 3 = 1 AND n > 2 THEN false ELSE true END AS valid FROM k")
def audit_chain_verify(s, d):
    """Logs of which a third had a subject changed, and a third lost an entry, after they were chained."""
    log = _log(s, d).filter("not (log % 3 = 1 and seq = 1)")
    subject = F.when((F.col("log") % 3 == 0) & (F.col("seq") == 2), "/e/other").otherwise(F.col("subject"))
    return A.verify_chain(log.withColumn("subject", subject))


@query(f"WITH RECURSIVE {CHAIN} SELECT {', '.join(_SHOWN)} FROM au WHERE NOT new AND seq BETWEEN 2 AND 4")
def audit_export_range(s, d):
    return _log(s, d).filter(F.col("seq").between(2, 4)).select(*_SHOWN)


@query(f"WITH RECURSIVE {CHAIN} SELECT log, seq, hash FROM au WHERE NOT new AND seq >= 3")
def audit_since(s, d):
    return _log(s, d).filter("seq >= 3").select("log", "seq", "hash")


@query(f"WITH RECURSIVE {CHAIN} SELECT log, max(seq) + 1 AS next_seq, arg_max(hash, seq) AS prev_hash FROM au WHERE NOT new GROUP BY 1")
def audit_recover(s, d):
    """Where the logs go on, read from lines of JSON of which the last one of each is broken."""
    log = _log(s, d)
    line = F.to_json(F.struct(*[F.col(c) for c in log.columns]))
    path = K.scratch(s, "audit")
    last = log.groupBy("log").agg(F.max("seq").alias("seq")).select(F.concat(F.lit('{"log":'), F.col("log").cast("string"), F.lit(',"seq":'), (F.col("seq") + 1).cast("string"), F.lit(',"ha')).alias("value"))
    log.select(line.alias("value")).union(last).write.text(path)
    return A.recover(K.read_jsonl(s, path, A.ENTRY))


# Quotas --------------------------------------------------------------------------------------------------------------
@query("WITH u AS (SELECT c_custkey AS tenant, CAST(coalesce(sum(o_totalprice), 0) AS BIGINT) AS b, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1), q AS (SELECT *, CASE WHEN tenant % 7 = 0 THEN 0 ELSE 2000000 END AS mb, CASE WHEN tenant % 5 = 0 THEN 0 ELSE 12 END AS mo, CASE WHEN tenant % 3 = 0 THEN 0 ELSE 40 END AS mr, CASE WHEN tenant % 2 = 0 THEN 0 ELSE 90 END AS mw, CASE WHEN tenant % 11 = 0 THEN 0 ELSE 6 END AS mc FROM u) SELECT tenant, (mb = 0 OR b <= mb) AND (mo = 0 OR n <= mo) AND (mr = 0 OR n * 3 <= mr) AND (mw = 0 OR tenant % 100 <= mw) AND (mc = 0 OR n % 8 <= mc) AS within FROM q")
def quota_within(s, d):
    """All five dimensions, each without a limit for some tenants."""
    u = X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg(F.sum("o_totalprice").cast("long").alias("b"), F.count("*").alias("n"))
    u = X.table(s, d, "customer").select(F.col("c_custkey").alias("tenant")).join(u, "tenant", "left").fillna(0)
    n, tenant = F.col("n"), F.col("tenant")
    usage = {"bytes": F.col("b"), "objects": n, "read_bps": n * 3, "write_bps": tenant % 100, "concurrent_requests": n % 8}
    most = {k: F.when(tenant % m == 0, 0).otherwise(v) for k, (m, v) in zip(usage, ((7, 2_000_000), (5, 12), (3, 40), (2, 90), (11, 6)), strict=True)}
    return u.select("tenant", G.within_quota(usage, most).alias("within"))


@query(f"WITH {TENANTS} SELECT tenant, 'limit '||tenant AS name, CAST(tenant % 9 AS BIGINT) AS max_objects FROM t")
def tenant_registry(s, d):
    """Tenants' quotas, saved as JSON and loaded again."""
    path = K.scratch(s, "tenants")
    c = X.table(s, d, "customer").select(F.col("c_custkey").alias("tenant"), F.concat(F.lit("limit "), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_custkey") % 9).alias("max_objects"))
    K.save_registry(c, path)
    return K.load_registry(s, path, c.schema)


# Compliance ----------------------------------------------------------------------------------------------------------
_CONTROLS_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{f}', '{k}', '{t}', {str(a).lower()})" for i, f, k, t, a in G.CONTROLS) + ") t(control_id, framework, category, title, automated)), e AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', 'collected', {n})" for n, i in enumerate(G.EVIDENCE[:-2])) + f", ('{G.EVIDENCE[-2]}', 'expired', 4), ('{G.EVIDENCE[-1]}', 'stale', 5)) t(control_id, status, k)), g AS (SELECT c.*, coalesce(status = 'collected', false) AS covered, CASE WHEN status = 'collected' THEN NULL WHEN status = 'stale' THEN CASE WHEN automated THEN 'medium' ELSE 'low' END WHEN automated THEN 'high' ELSE 'medium' END AS severity, CASE WHEN status = 'collected' THEN NULL WHEN status = 'stale' THEN '{G.STALE_REASON}' ELSE '{G.NONE_REASON}' END AS reason FROM c LEFT JOIN e USING (control_id))"


def _gaps(s, now=10_000_000):
    controls = s.createDataFrame(list(G.CONTROLS), "control_id string, framework string, category string, title string, automated boolean")
    status = {G.EVIDENCE[-1]: "stale"}
    age = {G.EVIDENCE[-2]: G.FRESH_S + 1}  # collected, but too long ago
    evidence = s.createDataFrame([(i, k, status.get(i, "collected"), now - age.get(i, 60)) for k, i in enumerate(G.EVIDENCE)], "control_id string, ord int, status string, collected_at long")
    return G.gaps(controls, evidence, now)


@query(f"WITH {_CONTROLS_SQL} SELECT control_id, framework, category, title, automated, covered, severity, reason FROM g")
def compliance_gaps(s, d):
    return _gaps(s)


@query(f"WITH {_CONTROLS_SQL} SELECT count(*) AS controls, count(*) FILTER (covered) AS covered, count(*) FILTER (severity = 'high') AS high, round(100.0 * count(*) FILTER (covered) / count(*), 4) AS coverage_pct, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'non-compliant' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'needs-attention' ELSE 'compliant' END AS status FROM g")
def compliance_report(s, d):
    high, critical = F.count_if(F.col("severity") == "high"), F.count_if(F.col("severity") == "critical")
    status = F.when(critical > 0, "non-compliant").when(high > 0, "needs-attention").otherwise("compliant")
    return _gaps(s).agg(F.count("*").alias("controls"), F.count_if("covered").alias("covered"), high.alias("high"), F.round(100 * F.count_if("covered") / F.count("*"), 4).alias("coverage_pct"), status.alias("status"))


# Placement and tuning ------------------------------------------------------------------------------------------------
_CHAINS = "ch AS (SELECT s_suppkey AS id, CAST(floor(greatest(s_acctbal, 0)) AS BIGINT) AS free, s_nationkey AS rack, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, sum(CAST(floor(greatest(s_acctbal, 0)) AS HUGEINT)) OVER (ORDER BY s_suppkey) AS acc FROM supplier), al AS (SELECT count(*) AS n, sum(CAST(free AS HUGEINT)) AS total FROM ch)"


def _byte(i: int) -> str:
    digit = lambda k: f"(instr('0123456789abcdef', substr(hash, {k}, 1)) - 1)"
    return f"({digit(2 * i + 1)} * 16 + {digit(2 * i + 2)})"


def _mixed(n: int) -> str:
    return "(" + " + ".join(f"CAST({_byte(i)} AS HUGEINT) * CAST('{131 ** (n - 1 - i)}' AS HUGEINT)" for i in range(n)) + ")"


_PRIMARY = f"{FILES}, {_CHAINS}, o AS (SELECT path, hash, {_mixed(16)} % total AS target, CAST({_mixed(8)} % n AS BIGINT) AS rr, n FROM files, al), pc AS (SELECT o.path, rr, n, min(i) AS ca FROM o JOIN ch ON target < acc GROUP BY 1, 2, 3)"


def _chains(s, d):
    return X.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.greatest("s_acctbal", F.lit(0.0))).alias("free"), F.col("s_nationkey").alias("rack"))


@query(f"WITH {_PRIMARY} SELECT path, a.id AS by_capacity, b.id AS by_turn FROM pc JOIN ch a ON a.i = ca JOIN ch b ON b.i = rr")
def placement_capacity(s, d):
    """Each file's chain by free capacity, and by turn."""
    o = files(s, d).select("path", "hash")
    a = G.replicas(o, _chains(s, d), 1, rack_aware=False).select("path", "hash", F.get("replicas", F.lit(0)).alias("by_capacity"))
    b = G.replicas(a, _chains(s, d), 1, primary=G.round_robin, rack_aware=False).withColumn("by_turn", F.get("replicas", F.lit(0)))
    return b.filter("by_turn is not null").groupBy("path", "by_turn").agg(F.min("by_capacity").alias("by_capacity")).select("path", "by_capacity", "by_turn")


@query(f"WITH {_PRIMARY}, t AS (SELECT path, id, rack, (i - ca + n) % n AS k FROM pc, ch), f AS (SELECT *, row_number() OVER (PARTITION BY path, rack ORDER BY k) AS nth FROM t), r AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY CAST(nth > 1 AS INT), k) AS place FROM f) SELECT path, string_agg(id, ',' ORDER BY place) AS replicas FROM r WHERE place <= 5 GROUP BY 1")
def placement_rack_aware(s, d):
    out = G.replicas(files(s, d).select("path", "hash"), _chains(s, d), 5)
    return out.filter("size(replicas) > 0").select("path", F.array_join(F.transform("replicas", lambda x: x.cast("string")), ",").alias("replicas")).distinct()


@query(f"WITH {_CHAINS} SELECT CAST(total AS DOUBLE) AS total FROM al")
def capacity_total(s, d):
    """Summed in 38 decimal digits: a long would overflow where free bytes are unknown and stand at their most."""
    return _chains(s, d).agg(F.sum(F.col("free").cast("decimal(38,0)")).cast("double").alias("total"))


_KIND = "CASE WHEN r + w = 0 THEN 'interactive' WHEN w > r AND a < 2097152 THEN 'streaming' WHEN r / (r + w) >= 0.9 AND a > 104857600 THEN 'training' WHEN r / (r + w) >= 0.9 AND a < 10485760 THEN 'inference' WHEN w > r THEN 'build' ELSE 'interactive' END"
_VOLUMES = f"u AS (SELECT l_suppkey AS volume, CAST(sum(CASE WHEN (l_returnflag = 'R') <> (l_suppkey % 4 = 0) THEN l_quantity ELSE 0 END) AS BIGINT) AS w, CAST(sum(CASE WHEN (l_returnflag = 'R') <> (l_suppkey % 4 = 0) THEN 0 ELSE l_quantity END) AS BIGINT) AS r0, count(*) % 3 AS k FROM lineitem GROUP BY 1), v AS (SELECT volume, CASE WHEN volume % 5 = 0 THEN r0 * 20 ELSE r0 END AS r, w, CASE k WHEN 0 THEN 1048576 WHEN 1 THEN 20971520 ELSE 209715200 END AS a FROM u), x AS (SELECT volume, {_KIND} AS kind FROM v)"
_PROFILES_SQL = "pf AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in p) + ")" for p in G.PROFILES) + f") t({', '.join(G.PROFILE_COLUMNS)}))"


def _volumes(s, d):
    li = X.table(s, d, "lineitem")
    write = (F.col("l_returnflag") == "R") != (F.col("l_suppkey") % 4 == 0)
    q = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0)).cast("long")
    u = li.groupBy(F.col("l_suppkey").alias("volume")).agg(q(write).alias("w"), q(~write).alias("r"), (F.count("*") % 3).alias("k"))
    a = F.when(F.col("k") == 0, 1 << 20).when(F.col("k") == 1, 20 << 20).otherwise(200 << 20)
    r = F.when(F.col("volume") % 5 == 0, F.col("r") * 20).otherwise(F.col("r"))
    return u.select("volume", G.recommend(r, F.col("w"), a).alias("kind"))


@query(f"WITH {_VOLUMES} SELECT volume, kind FROM x")
def tuning_recommend(s, d):
    return _volumes(s, d)


@query(f"WITH {_VOLUMES}, {_PROFILES_SQL} SELECT volume, pf.* FROM x JOIN pf ON x.kind = pf.kind")
def tuning_profiles(s, d):
    """The profile of each volume's kind of work."""
    p = s.createDataFrame(list(G.PROFILES), "kind string, read_ahead_bytes long, max_concurrent_fetches int, chunk_size_bytes long, inline_verify boolean, write_buffer_bytes long, replication_priority int, cache_policy string")
    return _volumes(s, d).join(F.broadcast(p), "kind").select("volume", *G.PROFILE_COLUMNS)
