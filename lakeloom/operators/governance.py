"""Policies, redaction, audit chains, quotas, compliance, placement."""

from __future__ import annotations

import datetime
import decimal
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is redacted, in this order, and by what.
PII = (
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"(?i)\b(sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36,}|xoxb-[A-Za-z0-9\-]+)", "[REDACTED_API_KEY]"),
    (r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*", "[REDACTED_BEARER]"),
)
#: What a text that any of these is found in must hold.
MUST = (
    lambda t: t.contains("@"),
    lambda t: t.rlike(r"\d-\d\d-\d"),
    lambda t: F.lower(t).contains("sk-") | F.lower(t).contains("ghp_") | F.lower(t).contains("xoxb-"),
    lambda t: F.lower(t).contains("bearer"),
)
#: The controls (id, framework, category, title, collected automatically) and those with automatic evidence.
CONTROLS = (
    ("CC6.1", "soc2", "security", "Logical Access Controls", True),
    ("CC6.2", "soc2", "security", "User Authentication", True),
    ("CC6.3", "soc2", "security", "Authorisation Enforcement", True),
    ("CC7.1", "soc2", "security", "Vulnerability Detection", False),
    ("CC7.2", "soc2", "incident_management", "Incident Response", False),
    ("A1.1", "soc2", "availability", "RPO / RTO Commitments", True),
    ("A1.2", "soc2", "availability", "Redundant Infrastructure", True),
    ("A1.3", "soc2", "backup_and_recovery", "Backup Integrity", True),
    ("C1.1", "soc2", "confidentiality", "Data Encryption at Rest", True),
    ("C1.2", "soc2", "cryptography", "Data Encryption in Transit", True),
    ("P1.1", "soc2", "privacy", "Data Classification", True),
    ("A.9.1", "iso27001", "access_control", "Access Control Policy", False),
    ("A.9.2", "iso27001", "access_control", "User Access Management", True),
    ("A.12.1", "iso27001", "change_management", "Change Management", False),
    ("A.12.3", "iso27001", "backup_and_recovery", "Information Backup", True),
    ("A.16.1", "iso27001", "incident_management", "Incident Management", False),
    ("A.18.1", "iso27001", "privacy", "Regulatory Compliance", False),
)
EVIDENCE = ("CC6.1", "CC6.3", "A1.3", "C1.1", "A.9.2", "A.12.3")
STALE_REASON, NONE_REASON = "Evidence is stale (>90 days)", "No evidence collected"
FRESH_S = 90 * 86_400
#: Permissions in the order in which they are shown; limits of a policy file.
PERMISSIONS = ("read", "write", "delete", "list")
POLICY_BYTES, POLICY_RULES = 1 << 20, 10_000
#: Share of a quota from which writes are throttled; shares and object sizes (MiB) that tell workloads apart;
#: bytes that a metadata operation and a mixed workload touch.
THROTTLE = 0.9
READ_SHARE, SMALL_WRITE, LARGE_READ, SMALL_READ = 0.9, 2, 100, 10
METADATA_BYTES, MIXED_MIB = 256, 512
#: Profiles by kind of workload.
PROFILE_COLUMNS = ("kind", "read_ahead_bytes", "max_concurrent_fetches", "chunk_size_bytes", "inline_verify", "write_buffer_bytes", "replication_priority", "cache_policy")
PROFILES = (
    ("training", 64 << 20, 32, 16 << 20, False, 256 << 20, 5, "lru"),
    ("inference", 0, 64, 4 << 20, True, 16 << 20, 8, "pin"),
    ("build", 4 << 20, 16, 8 << 20, True, 64 << 20, 3, "lru"),
    ("interactive", 1 << 20, 8, 4 << 20, True, 8 << 20, 5, "lfu"),
    ("streaming", 0, 4, 1 << 20, False, 128 << 20, 2, "bypass"),
)


def redact(text: Column, custom: tuple[tuple[str, str], ...] = ()) -> Column:
    """Each pattern's matches replaced, in order. A cheap test on what any match must hold spares most texts the pass."""
    for (pattern, by), must in zip((*PII, *custom), (*MUST, *[None] * len(custom)), strict=True):
        done = F.regexp_replace(text, pattern, by.replace("$", r"\$"))
        text = done if must is None else F.when(must(text), done).otherwise(text)
    return text


def has_pii(text: Column) -> Column:
    """Whether any pattern is found."""
    found = F.lit(False)
    for (pattern, _), must in zip(PII, MUST, strict=True):
        found = found | (must(text) & text.rlike(pattern))
    return found


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: a lone * or ** is everything, ** any number of segments, * within one. What
    stands before and after a * may overlap; a second * is an ordinary character."""
    if pattern in ("*", "**"):
        return "^.*$"
    out = ""
    for part in filter(None, pattern.split("/")):
        before, star, after = part.partition("*")
        one = f"(?={re.escape(before)})[^/]*" + (f"(?<={re.escape(after)})" if after else "") if star else re.escape(part)
        out += "(/+[^/]+)*" if part == "**" else "/+(?=[^/])" + one + "(?=/|$)"
    return f"^{out}/*$"


Rule = tuple[str, list[str], list[str], str]


def parse_policy(content: bytes) -> list[Rule]:
    """Rules (pattern, principals, permissions, effect) of a YAML file's bytes, in order. A file or a list of rules that is too
    large is an error, and so is a rule that lacks a field."""
    try:
        from yaml import safe_load as load
    except ImportError:  # JSON is YAML too, and all that can be read then
        from json import loads as load

    if len(content) > POLICY_BYTES:
        raise ValueError(f"policy file too large: {len(content)} bytes (limit {POLICY_BYTES})")
    rules = (load(content.decode()) or {}).get("rules") or []
    if len(rules) > POLICY_RULES:
        raise ValueError(f"too many rules: {len(rules)} (limit {POLICY_RULES})")
    out = []
    for r in rules:
        if set(r) != {"path_pattern", "principals", "permissions", "effect"} or r["effect"] not in ("allow", "deny") or not set(r["permissions"]) <= {*PERMISSIONS, "all"}:
            raise ValueError(f"not a rule: {r}")
        out.append((r["path_pattern"], list(r["principals"]), list(r["permissions"]), r["effect"]))
    return out


def load_policy(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a policy file, wherever Spark can read it."""
    found = spark.read.format("binaryFile").load(path).filter("length > 0")
    if found.filter(F.col("length") > POLICY_BYTES).count():
        raise ValueError(f"policy file too large (limit {POLICY_BYTES})")
    return [r for row in found.orderBy("path").collect() for r in parse_policy(bytes(row["content"]))]


def evaluate(requests: DataFrame, rules: list[Rule]) -> DataFrame:
    """requests (path, principal, permission) with effect and, where it is deny, reason: those of the first rule that matches,
    else deny. Rules are few and ordered; as one expression they need no join."""
    about = lambda path: F.concat(path, F.lit(" principal="), "principal", F.lit(" perm="), "permission", F.lit(")"))
    decided = F.struct(F.lit("deny").alias("effect"), F.concat(F.lit("no matching allow rule (path="), about(F.col("path"))).alias("reason"))
    for pattern, principals, permissions, what in reversed(rules):
        who = F.lit(True) if "*" in principals else F.col("principal").isin(principals)
        hit = F.col("path").rlike(glob_regex(pattern)) & who & (F.lit(True) if "all" in permissions else F.col("permission").isin(permissions))
        reason = F.concat(F.lit(f"denied by rule (pattern={pattern}"), about(F.lit(""))) if what == "deny" else F.lit(None).cast("string")
        decided = F.when(hit, F.struct(F.lit(what).alias("effect"), reason.alias("reason"))).otherwise(decided)
    return requests.withColumn("_d", decided).select(*requests.columns, "_d.effect", "_d.reason")


def allowed_permissions(paths: DataFrame, principal: str, rules: list[Rule]) -> DataFrame:
    """path, allowed: the permissions that a principal has there, in a fixed order."""
    each = paths.select("path", F.lit(principal).alias("principal"), F.posexplode(F.array(*map(F.lit, PERMISSIONS))).alias("k", "permission"))
    g = evaluate(each, rules).groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("effect") == "allow", F.struct("k", "permission")))).alias("found"))
    return g.select("path", F.transform("found", lambda x: x["permission"]).alias("allowed"))


def lineage_constraint(writes: DataFrame, principal: str, rules: list[Rule]) -> DataFrame:
    """writes (sink, sources: array of paths) with effect and reason: every source must be readable, else the first that isn't
    tells why; then the sink must be writable."""
    sources = writes.select("sink", F.posexplode("sources").alias("k", "path"), F.lit(principal).alias("principal"), F.lit("read").alias("permission"))
    denied = evaluate(sources, rules).filter("effect = 'deny'").groupBy("sink").agg(F.min_by("reason", "k").alias("blocked"))
    sink = evaluate(writes.select(F.col("sink").alias("path"), F.lit(principal).alias("principal"), F.lit("write").alias("permission")), rules)
    j = sink.withColumnRenamed("path", "sink").join(denied, "sink", "left")
    blocked = F.concat(F.lit("lineage constraint: write to "), "sink", F.lit(" blocked - "), "blocked")
    return j.select("sink", F.when(F.col("blocked").isNotNull(), "deny").otherwise(F.col("effect")).alias("effect"), F.coalesce(blocked, "reason").alias("reason"))


def in_scope(path: Column, scope: str, raw: bool = False) -> Column:
    """Whether a path is within a subtree, by whole segments; raw: whether it begins with the scope's characters."""
    scope = scope if scope.startswith("/") else f"/{scope}"
    return path.startswith(scope) if raw else (path == (scope.rstrip("/") or "/")) | path.startswith(scope.rstrip("/") + "/")


def within_quota(usage: dict[str, Column], most: dict[str, Column]) -> Column:
    """Whether every dimension of usage is within its limit; 0 is no limit."""
    out = F.lit(True)
    for name, used in usage.items():
        out = out & ((most[name] == 0) | (used <= most[name]))
    return out


def quota_decision(projected: Column, used: Column, most: Column, known: Column) -> Column:
    """deny for an unknown tenant or beyond the limit, throttle from a share of it on, else allow; 0 is no limit."""
    return F.when(~known, "deny").when(most == 0, "allow").when(projected > most, "deny").when(used / most >= THROTTLE, "throttle").otherwise("allow")


def recommend(read: Column, write: Column, average: Column) -> Column:
    """Workload kind by the share of reads and the average object."""
    mib, share = 1 << 20, read / (read + write)
    ladder = F.when(read + write == 0, "interactive").when((write > read) & (average < SMALL_WRITE * mib), "streaming")
    ladder = ladder.when((share >= READ_SHARE) & (average > LARGE_READ * mib), "training").when((share >= READ_SHARE) & (average < SMALL_READ * mib), "inference")
    return ladder.when(write > read, "build").otherwise("interactive")


def gaps(controls: DataFrame, evidence: DataFrame, now: int) -> DataFrame:
    """controls (control_id, automated, and others) with covered, severity and reason (null if covered), by each one's first
    evidence (control_id, ord, status, collected_at)."""
    first = evidence.groupBy("control_id").agg(F.min_by("status", "ord").alias("status"), F.min_by("collected_at", "ord").alias("at"))
    j = controls.join(first, "control_id", "left")
    covered = F.coalesce((F.col("status") == "collected") & (F.lit(now) - F.col("at") <= FRESH_S), F.lit(False))
    stale = F.coalesce(F.col("status") == "stale", F.lit(False))
    severity = F.when(covered, None).when(stale, F.when(F.col("automated"), "medium").otherwise("low")).otherwise(F.when(F.col("automated"), "high").otherwise("medium"))
    reason = F.when(covered, None).when(stale, STALE_REASON).otherwise(NONE_REASON)
    return j.select(*controls.columns, covered.alias("covered"), severity.alias("severity"), reason.alias("reason"))


def workload_bytes(kind: Column, size: Column, count: Column, percent: Column) -> Column:
    """Bytes that a workload touches, about: size in MiB, count of files or operations, percent changed."""
    mib = F.lit(1 << 20)
    out = F.when(kind.isin("sequential", "write-heavy"), size * mib).when(kind == "random-read", count * size * mib)
    out = out.when(kind == "mixed", MIXED_MIB * mib).when(kind == "metadata-storm", count * METADATA_BYTES)
    return out.when(kind == "checkpoint-delta", F.floor(size * mib * percent / 100)).cast("long")


# Placement -----------------------------------------------------------------------------------------------------------
def mixed(hash_: Column, n: int) -> Column:
    """The first n bytes of a hash as a number in base 131."""
    out = F.lit(0).cast("decimal(38,0)")
    for i in range(n):
        byte = F.conv(F.substring(hash_, 2 * i + 1, 2), 16, 10).cast("decimal(38,0)")
        out = ((out * F.lit(131).cast("decimal(38,0)")).cast("decimal(38,0)") + byte).cast("decimal(38,0)")
    return out


def _passed(bounds: Column, x: Column) -> Column:
    """How many of an array's rising bounds are at most x, by halving. x is kept beside the ends, so that it is made once."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"), x.alias("x"))

    def halved(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        open_, under = a["lo"] < a["hi"], F.get(bounds, mid) <= a["x"]
        return F.struct(F.when(open_ & under, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~under, mid).otherwise(a["hi"]).alias("hi"), a["x"].alias("x"))

    return F.aggregate(F.array_repeat(F.lit(0), F.length(F.bin(F.size(bounds)))), start, halved)["lo"]


def round_robin(objects: DataFrame, chains: DataFrame) -> DataFrame:
    """objects with place (from 0) of each one's chain: its hash's number modulo the number of chains."""
    count = chains.agg(F.count("*").cast("decimal(38,0)").alias("_n"))
    place = F.try_mod(mixed(F.col("hash"), 8), F.col("_n")).cast("int")
    return objects.crossJoin(F.broadcast(count)).withColumn("place", place).drop("_n")


#: Chains whose bounds are searched as one array; a row meets one such array, and one of all arrays' last bounds.
CHAIN_BLOCK = 256


def capacity_aware(objects: DataFrame, chains: DataFrame) -> DataFrame:
    """objects with place (from 0) of each one's chain: where its hash's number, modulo all free bytes, falls in their running
    sum; as round_robin() if none has any."""
    blocks = chains.groupBy(F.floor(F.col("place") / CHAIN_BLOCK).cast("int").alias("_block")).agg(F.array_sort(F.collect_list("upto")).alias("_bounds"), F.count("*").alias("_n"))
    ends = blocks.agg(F.array_sort(F.collect_list(F.element_at("_bounds", -1))).alias("_ends"), F.sum("_n").cast("decimal(38,0)").alias("_n"))
    o = objects.crossJoin(F.broadcast(ends.withColumn("_total", F.array_max("_ends"))))
    o = o.withColumn("_target", F.try_mod(mixed(F.col("hash"), 16), F.col("_total")))
    o = o.withColumn("_block", F.when(F.col("_target").isNotNull(), _passed(F.col("_ends"), F.col("_target"))))
    o = o.withColumn("_turn", F.when(F.col("_total") == 0, F.try_mod(mixed(F.col("hash"), 8), F.col("_n")).cast("int"))).drop("_ends", "_n", "_total")
    o = o.join(F.broadcast(blocks.drop("_n")), "_block", "left")
    place = F.col("_block") * CHAIN_BLOCK + _passed(F.col("_bounds"), F.col("_target"))
    return o.withColumn("place", F.coalesce("_turn", place)).drop("_block", "_bounds", "_target", "_turn")


def _walks(racks: list | None, count: int, n: int) -> Iterator[list[int]]:
    """For each place, from the last to the first: n places from it on, in a circle; with racks, first the next place of each
    rack, then the others. Going backwards, the next places of the nearest n racks are a list to whose front each place moves."""
    near: list[int] = []
    for p in range(2 * count - 1 if racks else count - 1, -1, -1):
        if racks:
            near = [p % count, *(x for x in near if racks[x] != racks[p % count])][:n]
        if p < count:
            after = [(p + k) % count for k in range(min(n, count))]
            yield [*near, *(x for x in after if x not in near)][:n]


#: Chains whose replicas are listed in one batch.
LISTED = 1 << 14


def listed(chains: DataFrame, n: int, rack_aware: bool) -> DataFrame:
    """place (from 0, in order of id), upto (free bytes to its end), replicas (ids of n chains) of each chain (id, free, rack).
    One task lists them; there are far fewer of them than objects."""
    field = chains.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        c = pa.Table.from_batches(read).combine_chunks()
        count, ids = len(c), c.column("id").combine_chunks()
        upto = list(itertools.accumulate(int(x) for x in c.column("free").to_pylist()))
        walks = _walks(c.column("rack").to_pylist() if rack_aware else None, count, n)
        places = iter(range(count - 1, -1, -1))
        while part := list(itertools.islice(places, LISTED)):
            found = list(itertools.islice(walks, len(part)))
            offsets = pa.array([0, *itertools.accumulate(map(len, found))], pa.int32())
            chosen = pa.ListArray.from_arrays(offsets, ids.take(pa.array([x for f in found for x in f], pa.int64())))
            bounds = pa.array([decimal.Decimal(upto[p]) for p in part], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), bounds, chosen], names=["place", "upto", "replicas"])

    free = F.coalesce(F.col("free").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    ordered = chains.select("id", free.alias("free"), "rack").repartition(1).sortWithinPartitions("id", "free", "rack")
    return ordered.mapInArrow(run, f"place int, upto decimal(38,0), replicas array<{field}>")


def replicas(objects: DataFrame, chains: DataFrame, n: int, primary=capacity_aware, rack_aware: bool = True) -> DataFrame:
    """objects (hash, ...) with replicas: ids of n chains (id, free, rack; in order of id), the primary first, then those after
    it; rack-aware, first one of each rack that isn't used yet, then the others. Which chains these are depends on the primary
    alone, so they are listed once a chain. primary is any function of objects and listed() chains that adds a place."""
    walks = listed(chains, n, rack_aware)
    o = primary(objects, walks).join(F.broadcast(walks.select("place", "replicas")), "place", "left")
    none = F.when(F.col("hash").isNotNull(), F.array().cast(walks.schema["replicas"].dataType))
    return o.select(*objects.columns, F.coalesce("replicas", none).alias("replicas"))


def bytes_fraction(used: Column, most: Column) -> Column:
    """Share of the quota in use; 0 without a limit."""
    return F.when(most == 0, 0.0).otherwise(used / most)


# Schedules, tokens ---------------------------------------------------------------------------------------------------
def next_run(schedule: dict, after: "datetime.datetime") -> "datetime.datetime | None":
    """When a schedule is due next: {"interval_secs": n}, {"cron": "minute hour day month weekday"} of numbers, lists and *, or
    {} for by hand only. ValueError for one that can't be read, or that is never due."""
    if "interval_secs" in schedule:
        return after + datetime.timedelta(seconds=int(schedule["interval_secs"]))
    if "cron" not in schedule:
        return None
    parts = schedule["cron"].split()
    if len(parts) != 5:
        raise ValueError(f"not a schedule: {schedule['cron']}")
    allowed = [None if p == "*" else {int(x) for x in p.split(",")} for p in parts]
    at = after.replace(second=0, microsecond=0) + datetime.timedelta(minutes=1)
    fits = lambda k, v: allowed[k] is None or v in allowed[k]
    last = at + datetime.timedelta(days=366 * 8)
    while at < last:
        if not (fits(2, at.day) and fits(3, at.month) and fits(4, at.isoweekday() % 7)):
            at = at.replace(hour=0, minute=0) + datetime.timedelta(days=1)
        elif not fits(1, at.hour):
            at = at.replace(minute=0) + datetime.timedelta(hours=1)
        elif not fits(0, at.minute):
            at += datetime.timedelta(minutes=1)
        else:
            return at
    raise ValueError(f"never due: {schedule['cron']}")


#: Fixed value: seconds by which a token may be late.
LEEWAY_S = 30


def token_state(now: Column, expires_at: Column, revoked: Column, signed: Column) -> Column:
    """revoked, expired, bad signature or ok, in this order."""
    return F.when(revoked, "revoked").when(now > expires_at + LEEWAY_S, "expired").when(~signed, "bad signature").otherwise("ok")
