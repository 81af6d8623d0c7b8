"""The engine as a service: capabilities by name, with scope, policy, hooks, redaction and audit around each call.

State is a set of tables; a write makes a new snapshot of the table it changes, which is written to the shared scratch
folder, so calls may be many but each is one Spark job or a few. Results are plain Python values.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import audit as A
from lakeloom.operators import content as C
from lakeloom.operators import governance as G
from lakeloom.operators import lineage as L
from lakeloom.operators import store as V
from lakeloom.operators import textindex as P


class ApiError(Exception):
    """A call that failed, with one of the codes of the subclasses."""

    code = "internal"


class NotFound(ApiError):
    code = "not_found"


class Forbidden(ApiError):
    code = "forbidden"


class InvalidArgument(ApiError):
    code = "invalid_argument"


class Unsupported(ApiError):
    code = "not_implemented"


#: Capabilities by plane, in order, and those that change something.
CAPABILITIES = {
    "fs": ("stat", "list", "read", "read_text", "read_tensor", "read_schema", "write", "append", "delete"),
    "semantic": ("query", "similar", "embed", "describe"),
    "version": ("log", "diff", "branch_create", "branch_list", "checkout", "commit", "tag"),
    "lineage": ("upstream", "downstream", "provenance", "record"),
    "policy": ("show", "check", "audit", "set"),
    "agent": ("scratchpad_create", "checkpoint", "fork"),
}
MUTATING = frozenset("fs_write fs_append fs_delete version_branch_create version_checkout version_commit version_tag lineage_record policy_set agent_scratchpad_create agent_checkpoint agent_fork".split())
ZERO = "0" * 64


def catalog() -> list[tuple[str, str, bool]]:
    """(name, plane, whether it changes something) of every capability."""
    return [(f"{plane}.{verb}", plane, f"{plane}_{verb}" in MUTATING) for plane, verbs in CAPABILITIES.items() for verb in verbs]


def parse_capability(name: str) -> str | None:
    """The method of a capability by its name, with dots or underscores, and with or without a prefix before its plane; None if
    there is no such capability."""
    found = {f"{plane}_{verb}" for plane, verbs in CAPABILITIES.items() for verb in verbs}
    plain = name.replace(".", "_")
    return next((x for x in (plain, plain.partition("_")[2]) if x in found), None)


FILE = "path string, data binary"
EDGE = "id string, ts long, kind string, source_hash string, sink_hash string, agent string"
COMMIT = "hash string, tree_hash string, parents array<string>, author string, email string, ts long, message string"


@dataclass
class Engine:
    """files: path, data. rules: a policy's; subtree: the only paths that may be touched; redact: whether texts are redacted;
    index: for searches; embedder: for vectors. write_hooks get (path, bytes) and auth_hooks (principal, path, permission) before
    the act, and stop it by an exception."""

    spark: SparkSession
    files: DataFrame | None = None
    rules: list[G.Rule] | None = None
    subtree: str | None = None
    redact: bool = False
    index: P.Index | None = None
    embedder: Callable | None = None
    write_hooks: tuple[Callable, ...] = ()
    auth_hooks: tuple[Callable, ...] = ()
    clock: Callable[[], int] = lambda: int(time.time() * 1000)
    branches: dict[str, str] = field(default_factory=dict)
    head: tuple[str, str] = ("branch", "main")

    def __post_init__(self) -> None:
        self.files = V.written(self.files.select("path", "data"), "files") if self.files is not None else self.spark.createDataFrame([], FILE)
        self.empty = self.spark.createDataFrame([], "path string")
        self.edges = self.spark.createDataFrame([], EDGE)
        self.commits = self.spark.createDataFrame([], COMMIT)
        self.snapshots: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}
        self.entries_log = self.spark.createDataFrame([], A.ENTRY)
        self._events: list[tuple] = []
        self._manifests: DataFrame | None = None
        self._entries: DataFrame | None = None

    # Calls -----------------------------------------------------------------------------------------------------------
    def invoke(self, principal: str, name: str, args: dict | None = None):
        """Call a capability by name. Its end, good or bad, stands in the audit log."""
        method = parse_capability(name)
        try:
            if method is None:
                raise InvalidArgument(f"unknown capability: {name}")
            out = getattr(self, f"_{method}")(principal, dict(args or {}))
        except ApiError as e:
            self._record("capability.error", name, principal, {"message": str(e)})
            raise
        except (ValueError, KeyError) as e:
            self._record("capability.error", name, principal, {"message": str(e)})
            raise InvalidArgument(str(e)) from e
        self._record("capability.invoke", name, principal, {})
        return out

    def _record(self, event: str, subject: str, actor: str, detail: dict[str, str]) -> None:
        self._events.append((0, len(self._events), self.clock(), event, subject, actor, detail))

    def audit_log(self) -> DataFrame:
        """The chained log of all calls so far."""
        if self._events:
            new = self.spark.createDataFrame(self._events, "log long, ord long, ts long, event_type string, subject string, actor string, detail map<string,string>")
            self.entries_log = V.written(A.append(self.entries_log, new), "audit")
            self._events = []
        return self.entries_log

    def _allowed(self, principal: str, path: str, permission: str) -> str:
        """The path in its normal form, if the call may touch it."""
        path = normal(path)
        if self.subtree is not None and not under(path, self.subtree):
            raise Forbidden(f"path {path} outside subtree {self.subtree}")
        if self.rules is not None:
            request = self.spark.createDataFrame([(path, principal, permission)], "path string, principal string, permission string")
            decision = G.evaluate(request, self.rules).first()
            allow = decision["effect"] == "allow"
            self._record(f"policy.{decision['effect']}", path, principal, {"perm": permission} | ({} if allow else {"reason": decision["reason"]}))
            if not allow:
                raise Forbidden(decision["reason"])
        for hook in self.auth_hooks:
            try:
                hook(principal, path, permission)
            except Exception as e:
                raise Forbidden(str(e)) from e
        return path

    @staticmethod
    def _need(args: dict, name: str) -> str:
        if not isinstance(args.get(name), str):
            raise InvalidArgument(f'missing field "{name}"')
        return args[name]

    # Files -----------------------------------------------------------------------------------------------------------
    def manifests(self) -> DataFrame:
        if self._manifests is None:
            self._manifests = V.written(V.manifests(self.files), "manifests")
        return self._manifests

    def entries(self) -> DataFrame:
        """Directory entries of the working tree."""
        if self._entries is None:
            rows = self.manifests().select(F.lit("work").alias("tree"), "path", F.col("file_hash").alias("object_hash"), F.lit("file").alias("kind"))
            rows = rows.unionByName(self.empty.select(F.lit("work").alias("tree"), "path", F.lit(V.EMPTY).alias("object_hash"), F.lit("dir").alias("kind")))
            self._entries = V.written(V.merkle(rows), "entries")
        return self._entries

    def _replace(self, files: DataFrame, empty: DataFrame | None = None) -> None:
        self.files = V.written(files.select("path", "data"), "files")
        if empty is not None:
            self.empty = V.written(empty.select("path").distinct(), "empty-directories")
        self._manifests = self._entries = None

    def _kind(self, path: str) -> str | None:
        if path == "/":
            return "dir"
        if not self.files.filter(F.col("path") == path).isEmpty():
            return "file"
        below = lambda df: not df.filter((F.col("path") == path) | F.col("path").startswith(path + "/")).isEmpty()
        return "dir" if below(self.files) or below(self.empty) else None

    def _objects(self) -> DataFrame:
        e, m = self.entries(), self.manifests()
        dirs = e.select("path", F.lit("dir").alias("kind"), F.col("dir_hash").alias("hash"), F.lit(0).cast("long").alias("size")).distinct()
        empty = self.empty.select("path", F.lit("dir").alias("kind"), F.lit(V.EMPTY).alias("hash"), F.lit(0).cast("long").alias("size"))
        return dirs.unionByName(empty).unionByName(m.select("path", F.lit("file").alias("kind"), F.col("file_hash").alias("hash"), "size"))

    def stat(self, path: str) -> dict:
        found = self._objects().filter(F.col("path") == normal(path)).first()
        if found is None:
            raise NotFound(f"no such path: {path}")
        return found.asDict()

    def list(self, path: str, recursive: bool = False) -> list[dict]:
        path = normal(path)
        kind = self._kind(path)
        if kind is None:
            raise NotFound(f"no such path: {path}")
        if kind != "dir":
            raise InvalidArgument(f"not a directory: {path}")
        inside = F.col("path").startswith(path.rstrip("/") + "/") & (F.col("path") != path)
        where = inside if recursive else inside & (V.parent(F.col("path")) == path)
        return [r.asDict() for r in self._objects().filter(where).orderBy("path").collect()]

    def read(self, path: str) -> bytes:
        path = normal(path)
        found = self.files.filter(F.col("path") == path).first()
        if found is None:
            raise InvalidArgument(f"not a file: {path}") if self._kind(path) else NotFound(f"no such path: {path}")
        return bytes(found["data"])

    def write(self, path: str, data: bytes) -> dict:
        path = normal(path)
        for hook in self.write_hooks:
            try:
                hook(path, data)
            except Exception as e:
                raise Forbidden(str(e)) from e
        if path == "/" or self._kind(path) == "dir":
            raise InvalidArgument(f"is a directory: {path}")
        above = [x for x in ancestors(path)[1:] if x != path]
        if above and not self.files.filter(F.col("path").isin(above)).isEmpty():
            raise InvalidArgument(f"not a directory: {above_of(path)}")
        new = self.spark.createDataFrame([(path, bytearray(data))], FILE)
        self._replace(V.put(self.files, new), self.empty.filter(~F.col("path").isin(ancestors(path))))
        return self._written(path)

    def _written(self, path: str) -> dict:
        """path, hash and size of one file, from its own bytes."""
        m = V.manifests(self.files.filter(F.col("path") == path)).first()
        return {"path": path, "hash": m["file_hash"], "size": m["size"]}

    def delete(self, path: str) -> dict:
        path = normal(path)
        result = V.delete_results(self.files.select("path"), self.empty, self.spark.createDataFrame([(path,)], "path string")).first()["result"]
        if result == "missing":
            raise NotFound(f"no such entry: {path}")
        if result != "ok":
            raise InvalidArgument("cannot delete root" if result == "root" else f"directory not empty: {path}")
        self._replace(self.files.filter(F.col("path") != path), self.empty.filter(F.col("path") != path))
        return {"deleted": path}

    def mkdir(self, path: str) -> None:
        path = normal(path)
        made = V.mkdir_results(self.files.select("path"), self.empty, self.spark.createDataFrame([(path,)], "path string")).first()
        if made["result"] != "ok":
            raise InvalidArgument(f"path exists: {path}")
        if made["new"]:
            self._replace(self.files, self.empty.filter(~F.col("path").isin(ancestors(path))).union(self.spark.createDataFrame([(path,)], "path string")))

    def rename(self, old: str, new: str) -> None:
        old, new = normal(old), normal(new)
        if self._kind(old) is None:
            raise NotFound(f"no such path: {old}")
        self._replace(C.rename(self.files, old, new), C.rename(self.empty, old, new))

    def fork(self, old: str, new: str) -> None:
        old, new = normal(old), normal(new)
        if self._kind(old) is None:
            raise NotFound(f"no such path: {old}")
        self._replace(C.fork(self.files, old, new), C.fork(self.empty, old, new))

    def _fs_stat(self, who, args):
        return self.stat(self._allowed(who, self._need(args, "path"), "read"))

    def _fs_list(self, who, args):
        return self.list(self._allowed(who, self._need(args, "path"), "list"), bool(args.get("recursive")))

    def _fs_read(self, who, args):
        path = self._allowed(who, self._need(args, "path"), "read")
        if self._kind(path) != "file":
            self.read(path)
        part = V.byte_range(F.col("data"), F.lit(int(args.get("offset", 0))), F.lit(int(args.get("length", -1))))
        r = self.files.filter(F.col("path") == path).select(F.lower(F.hex(part)).alias("bytes_hex"), F.octet_length(part).alias("size"), F.octet_length("data").alias("total_size")).first()
        return r.asDict()

    def _fs_read_text(self, who, args):
        path = self._allowed(who, self._need(args, "path"), "read")
        if self._kind(path) != "file":
            self.read(path)
        from lakeloom.functions.text import utf8

        text = utf8(F.col("data"))
        r = self.files.filter(F.col("path") == path).select((G.redact(text) if self.redact else text).alias("text"), F.octet_length("data").alias("size")).first()
        return r.asDict()

    def _fs_read_tensor(self, who, args):
        raise Unsupported("reads by format are not part of this plane")

    _fs_read_schema = _fs_read_tensor

    def _fs_write(self, who, args):
        path, content = self._need(args, "path"), self._need(args, "content")
        return self.write(self._allowed(who, path, "write"), content.encode())

    def _fs_append(self, who, args):
        path, content = self._need(args, "path"), self._need(args, "content")
        path = self._allowed(who, path, "write")
        before = self.read(path) if self._kind(path) == "file" else b""
        return self.write(path, before + content.encode())

    def _fs_delete(self, who, args):
        return self.delete(self._allowed(who, self._need(args, "path"), "delete"))

    # Search ----------------------------------------------------------------------------------------------------------
    def _semantic_query(self, who, args):
        if self.index is None:
            raise Unsupported("semantic plane disabled")
        query, limit = self._need(args, "q"), int(args.get("limit", 10))
        from lakeloom.functions.text import utf8

        ids = self.index.documents.select("doc_id", "path")
        docs = self.files.join(ids, "path").select("doc_id", utf8(F.col("data")).alias("text"))
        found = P.hits(self.index, docs, query, limit).drop("doc_id").orderBy(F.desc("score"), "path")
        shown = found.withColumn("snippet", G.redact(F.col("snippet"))) if self.redact else found
        return [r.asDict() for r in shown.collect()]

    def _semantic_similar(self, who, args):
        self._allowed(who, self._need(args, "path"), "read")
        raise Unsupported("similar needs stored embeddings")

    def _semantic_embed(self, who, args):
        path = self._allowed(who, self._need(args, "path"), "read")
        if self.embedder is None:
            raise Unsupported("embed needs an embedder")
        return {"embedding": self.embedder([self.read(path).decode("utf-8", "replace")])[0]}

    def _semantic_describe(self, who, args):
        raise Unsupported("describe needs an embedder")

    # Versions --------------------------------------------------------------------------------------------------------
    def head_commit(self) -> str | None:
        return self.branches.get(self.head[1]) if self.head[0] == "branch" else self.head[1]

    def commit(self, name: str, email: str, message: str) -> str:
        """A commit of the working tree on the branch that HEAD stands for; with a detached HEAD it fails."""
        if self.head[0] != "branch":
            raise InvalidArgument("cannot commit on a detached HEAD")
        root = V.roots(self.entries()).first()
        tree, before, ts = root["dir_hash"] if root else V.EMPTY, self.head_commit(), self.clock()
        parents = [before] if before else []
        hash_ = hashlib.sha256(json.dumps([tree, parents, name, email, ts, message]).encode()).hexdigest()
        row = self.spark.createDataFrame([(hash_, tree, parents, name, email, ts, message)], COMMIT)
        self.commits = V.written(self.commits.unionByName(row), "commits")
        self.snapshots[hash_] = (self.files, self.empty, self.entries())
        self.branches[self.head[1]] = hash_
        return hash_

    def _resolve(self, target: str) -> str:
        found = self.branches.get(target) or (target if target in self.snapshots else None)
        if found is None:
            raise InvalidArgument(f"not a branch or commit hash: {target}")
        return found

    def checkout(self, target: str) -> dict:
        commit = self._resolve(target)
        self.files, self.empty, self._entries = self.snapshots[commit]
        self._manifests = None
        self.head = ("branch", target) if target in self.branches else ("detached", commit)
        return {"head": target, "kind": self.head[0]}

    def log(self, limit: int = 20) -> list[dict]:
        at = self.head_commit()
        if at is None:
            return []
        heads = self.spark.createDataFrame([("HEAD", at)], "branch string, hash string")
        log = V.first_parent_log(self.commits, heads, min(limit, len(self.snapshots))).orderBy("depth")
        return [{k: r[k] for k in ("hash", "tree_hash", "parents", "author", "email", "ts", "message")} for r in log.collect()]

    def diff(self, a: str, b: str) -> list[dict]:
        ea, eb = (self.snapshots[x][2].withColumn("tree", F.lit(x)) for x in (a, b))
        root = lambda e: V.roots(e).select(F.col("dir_hash").alias("hash"))
        return [r.asDict() for r in V.diff_trees(ea.unionByName(eb), root(ea), root(eb)).collect()]

    def branch_create(self, name: str, at: str | None = None) -> dict:
        if name in self.branches:
            raise InvalidArgument(f"branch exists: {name}")
        commit = at or self.head_commit()
        if commit not in self.snapshots:
            raise NotFound("no commit to branch from")
        self.branches[name] = commit
        return {"name": name, "head": commit}

    def branch(self, name: str | None = None) -> dict:
        """All branches and their commits; with a name, after that one was made."""
        if name is not None:
            self.branch_create(name)
        return dict(self.branches)

    def branch_delete(self, name: str) -> None:
        if self.head == ("branch", name):
            raise InvalidArgument(f"branch is checked out: {name}")
        if self.branches.pop(name, None) is None:
            raise NotFound(f"no such branch: {name}")

    def _version_log(self, who, args):
        return self.log(int(args.get("limit", 20)))

    def _version_diff(self, who, args):
        head = self.head_commit()
        if head is None:
            raise NotFound("HEAD")
        first = self.commits.filter(F.col("hash") == head).first()["parents"]
        a = self._resolve(args["from"]) if "from" in args else (first or [head])[0]
        return self.diff(a, self._resolve(args["to"]) if "to" in args else head)

    def _version_branch_create(self, who, args):
        return self.branch_create(self._need(args, "name"))

    def _version_branch_list(self, who, args):
        return [{"name": n, "head": h} for n, h in sorted(self.branches.items())]

    def _version_checkout(self, who, args):
        return self.checkout(self._need(args, "target"))

    def _version_commit(self, who, args):
        return {"commit": self.commit(args.get("author_name", "anonymous"), args.get("author_email", "anon@example.com"), self._need(args, "message"))}

    def _version_tag(self, who, args):
        name, commit = self._need(args, "name"), self._need(args, "commit")
        self.branch_create(name, commit)
        return {"tag": name, "commit": commit}

    # Lineage ---------------------------------------------------------------------------------------------------------
    def _reach(self, args, up: bool):
        found = L.reach(self.edges, self._hash(args, "hash"), int(args.get("depth", 3)), up)
        return [{"id": r["id"], "ts": r["ts"], "kind": r["kind"], "source": r["source_hash"], "sink": r["sink_hash"], "agent": r["agent"]} for r in found.orderBy("ts", "id").collect()]

    def _hash(self, args, name: str) -> str:
        h = self._need(args, name)
        if len(h) != 64 or set(h.lower()) - set("0123456789abcdef"):
            raise InvalidArgument(f'invalid hash for "{name}"')
        return h.lower()

    def _lineage_upstream(self, who, args):
        return self._reach(args, True)

    def _lineage_downstream(self, who, args):
        return self._reach(args, False)

    def _lineage_provenance(self, who, args):
        h = self._hash(args, "hash")
        rows = L.parents(self.edges, h).orderBy("ts", "id").collect()
        return {"subject": h, "direct_parents": [{"kind": r["kind"], "source": r["source_hash"], "agent": r["agent"], "ts": r["ts"]} for r in rows]}

    def _lineage_record(self, who, args):
        source, sink, kind = self._hash(args, "source"), self._hash(args, "sink"), args.get("kind", "derive")
        if source == sink:
            raise InvalidArgument("lineage source and sink must differ")
        if ZERO in (source, sink):
            raise InvalidArgument("lineage hashes must not be zero")
        if kind not in L.KINDS:
            raise InvalidArgument(f"unknown edge kind: {kind}")
        edge = (uuid.uuid4().hex, self.clock(), kind, source, sink, who)
        self.edges = V.written(self.edges.unionByName(self.spark.createDataFrame([edge], EDGE)), "edges")
        return {"edge_id": edge[0]}

    # Policy ----------------------------------------------------------------------------------------------------------
    def _rules(self) -> list[G.Rule]:
        if self.rules is None:
            raise Unsupported("policy plane disabled")
        return self.rules

    def _policy_show(self, who, args):
        path = self._need(args, "path")
        found = G.allowed_permissions(self.spark.createDataFrame([(path,)], "path string"), who, self._rules()).first()
        return {"path": path, "principal": who, "allowed": found["allowed"]}

    def _policy_check(self, who, args):
        row = tuple(self._need(args, k) for k in ("path", "principal", "operation"))
        if row[2] not in G.PERMISSIONS:
            raise InvalidArgument(f"unknown permission: {row[2]}")
        d = G.evaluate(self.spark.createDataFrame([row], "path string, principal string, permission string"), self._rules()).first()
        return {"decision": d["effect"]} | ({"reason": d["reason"]} if d["effect"] == "deny" else {})

    def _policy_audit(self, who, args):
        since = int(args.get("since", 0))
        return [r.asDict() for r in self.audit_log().filter(F.col("seq") >= since).orderBy("seq").collect()]

    def _policy_set(self, who, args):
        raise Unsupported("policies are set where they are stored")

    # Agents ----------------------------------------------------------------------------------------------------------
    def _agent_scratchpad_create(self, who, args):
        path = f"/scratch/{args.get('name', 'scratch')}-{uuid.uuid4()}"
        self.mkdir(path)
        return {"path": path}

    def _agent_checkpoint(self, who, args):
        path, state = self._need(args, "path"), self._need(args, "state")
        done = self.write(self._allowed(who, path, "write"), state.encode())
        return {"path": done["path"], "hash": done["hash"]}

    def _agent_fork(self, who, args):
        old, new = self._need(args, "from_path"), self._need(args, "to_path")
        old, new = self._allowed(who, old, "read"), self._allowed(who, new, "write")
        self.fork(old, new)
        return {"from": old, "to": new}


def normal(path: str) -> str:
    """A path in its normal form; InvalidArgument for one that is not absolute, or that has . or .. in it."""
    parts = [x for x in path.replace("\\", "/").split("/") if x]
    if not path.replace("\\", "/").startswith("/") or {".", ".."} & set(parts):
        raise InvalidArgument(f"bad path: {path}")
    return "/" + "/".join(parts)


def under(path: str, root: str) -> bool:
    root = root.rstrip("/")
    return not root or path == root or path.startswith(root + "/")


def ancestors(path: str) -> list[str]:
    """The directories above a path, and itself."""
    parts = path.strip("/").split("/")
    return ["/", *("/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1))]


def above_of(path: str) -> str:
    """The directory that a path stands in."""
    return path.rsplit("/", 1)[0] or "/"
