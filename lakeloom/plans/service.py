"""Queries on the service: its capabilities, and a table of calls with what each must give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakeloom import api
from lakeloom.operators import governance as G
from lakeloom.plans.registry import FILES, files, query

_CATALOG = ", ".join(f"('{n}', '{p}', {str(m).lower()})" for n, p, m in api.catalog())


@query(f"SELECT * FROM (VALUES {_CATALOG}) t(name, plane, mutates)")
def capability_catalog(s, d):
    return s.createDataFrame(api.catalog(), "name string, plane string, mutates boolean")


RULES: list[G.Rule] = [("/secret/**", ["root"], ["all"], "allow"), ("/secret/**", ["*"], ["all"], "deny"), ("/src1/**", ["*"], ["read", "list"], "allow"), ("/work/**", ["*"], ["all"], "allow"), ("/copy/**", ["*"], ["read", "list", "write"], "allow")]
_H = ["a" * 64, "b" * 64, "c" * 64]
#: Principal, capability, arguments, what is shown of the result, and what that must be: SQL over the documents, or an error's code.
_CALLS = (
    ("ann", "fs.write", {"path": "/work/a.txt", "content": "mail ann@example.org"}, "size", "'20'"),
    ("ann", "fs.read_text", {"path": "/work//a.txt/"}, "text", "'mail [REDACTED_EMAIL]'"),
    ("ann", "x.fs.read", {"path": "/work/a.txt", "offset": 5, "length": 3}, "bytes_hex", "'616e6e'"),
    ("ann", "fs_read", {"path": "/work/a.txt", "offset": 500}, "size", "'0'"),
    ("ann", "fs.append", {"path": "/work/a.txt", "content": "!"}, "size", "'21'"),
    ("ann", "fs.append", {"path": "/work/new/b.txt", "content": "b"}, "size", "'1'"),
    ("ann", "fs.stat", {"path": "/work/new"}, "kind", "'dir'"),
    ("ann", "fs.list", {"path": "/work"}, "path", "'/work/a.txt,/work/new'"),
    ("ann", "fs.list", {"path": "/work", "recursive": True}, "path", "'/work/a.txt,/work/new,/work/new/b.txt'"),
    ("ann", "fs.list", {"path": "/src1", "recursive": True}, "len", "(SELECT CAST(count(*) + count(DISTINCT lang) AS VARCHAR) FROM files WHERE source = 'src1')"),
    ("ann", "fs.list", {"path": "/work/a.txt"}, "", "'error invalid_argument'"),
    ("ann", "fs.write", {"path": "/src1/x", "content": "x"}, "", "'error forbidden'"),
    ("ann", "fs.read", {"path": "/secret/x"}, "", "'error forbidden'"),
    ("root", "fs.write", {"path": "/secret/x", "content": "x"}, "size", "'1'"),
    ("ann", "fs.read", {"path": "/work/none"}, "", "'error not_found'"),
    ("ann", "fs.read", {"path": "/work/../secret/x"}, "", "'error invalid_argument'"),
    ("ann", "fs.stat", {}, "", "'error invalid_argument'"),
    ("ann", "fs.delete", {"path": "/work/new"}, "", "'error invalid_argument'"),
    ("ann", "fs.read_tensor", {"path": "/work/a.txt"}, "", "'error not_implemented'"),
    ("ann", "fs.unknown", {}, "", "'error invalid_argument'"),
    ("ann", "version.commit", {"message": "one"}, "commit:len", "'64'"),
    ("ann", "agent.fork", {"from_path": "/work", "to_path": "/copy"}, "to", "'/copy'"),
    ("ann", "fs.delete", {"path": "/work/new/b.txt"}, "deleted", "'/work/new/b.txt'"),
    ("ann", "version.commit", {"message": "two", "author_name": "Ann"}, "commit:len", "'64'"),
    ("ann", "version.log", {"limit": 5}, "message", "'two,one'"),
    ("ann", "version.diff", {}, "op+path", "'add /copy/a.txt,add /copy/new/b.txt,del /work/new/b.txt'"),
    ("ann", "version.branch_create", {"name": "side"}, "name", "'side'"),
    ("ann", "version.branch_create", {"name": "side"}, "", "'error invalid_argument'"),
    ("ann", "version.branch_list", {}, "name", "'main,side'"),
    ("ann", "version.checkout", {"target": "side"}, "kind", "'branch'"),
    ("ann", "version.checkout", {"target": "nowhere"}, "", "'error invalid_argument'"),
    ("ann", "lineage.record", {"source": _H[0], "sink": _H[1]}, "edge_id:len", "'32'"),
    ("ann", "lineage.record", {"source": _H[1], "sink": _H[2], "kind": "copy"}, "edge_id:len", "'32'"),
    ("ann", "lineage.record", {"source": _H[1], "sink": _H[1]}, "", "'error invalid_argument'"),
    ("ann", "lineage.record", {"source": api.ZERO, "sink": _H[1]}, "", "'error invalid_argument'"),
    ("ann", "lineage.record", {"source": _H[0], "sink": _H[1], "kind": "steal"}, "", "'error invalid_argument'"),
    ("ann", "lineage.upstream", {"hash": _H[2]}, "kind", "'derive,copy'"),
    ("ann", "lineage.downstream", {"hash": _H[0], "depth": 1}, "kind", "'derive'"),
    ("ann", "lineage.provenance", {"hash": _H[2]}, "subject", f"'{_H[2]}'"),
    ("ann", "lineage.upstream", {"hash": "zz"}, "", "'error invalid_argument'"),
    ("ann", "policy.show", {"path": "/src1/en/1.txt"}, "allowed", "'read,list'"),
    ("ann", "policy.check", {"path": "/secret/x", "principal": "ann", "operation": "read"}, "decision", "'deny'"),
    ("ann", "policy.set", {}, "", "'error not_implemented'"),
    ("ann", "semantic.query", {"q": "the"}, "", "'error not_implemented'"),
    ("ann", "agent.checkpoint", {"path": "/work/state", "state": "s"}, "path", "'/work/state'"),
    ("ann", "agent.scratchpad_create", {"name": "pad"}, "path:start", "'/scratch/pad-'"),
    ("ann", "policy.audit", {}, "event_type:errors", ""),
)
#: The audit log names every call that failed.
_FAILED = sum("error " in want for *_, want in _CALLS)


def shown(result, what: str) -> str:
    """A part of a call's result as text."""
    key, _, how = what.partition(":")
    if what == "len":
        return str(len(result))
    if what == "op+path":
        return ",".join(f"{x['op']} {x['path']}" for x in result)
    if how == "errors":
        return str(sum(x[key] == "capability.error" for x in result))
    value = ",".join(x[key] for x in result) if isinstance(result, list) else result[key]
    if how == "len":
        return str(len(value))
    return value[:13] if how == "start" else ",".join(value) if isinstance(value, list) else str(value)


@query(f"WITH {FILES} SELECT n, result FROM (VALUES " + ", ".join(f"({k}, {want or repr(str(_FAILED))})" for k, (*_, want) in enumerate(_CALLS)) + ") t(n, result)")
def invoke_calls(s, d):
    """One call after another on an engine over all documents: results, or the codes of errors."""
    work = files(s, d).select("path", F.col("text").cast("binary").alias("data"))
    ticks = iter(range(1_700_000_000_000, 1 << 60))
    engine = api.Engine(s, files=work, rules=RULES, redact=True, clock=lambda: next(ticks))
    out = []
    for k, (who, name, args, what, _) in enumerate(_CALLS):
        try:
            out.append((k, shown(engine.invoke(who, name, json.loads(json.dumps(args))), what)))
        except api.ApiError as e:
            out.append((k, f"error {e.code}"))
    return s.createDataFrame(out, "n int, result string")


@query("SELECT * FROM (VALUES ('/README.md', 'A volume to try things with.'), ('/datasets/iris.parquet', 'sepal_length petal_length'), ('/models/tiny.safetensors', '')) t(path, text) UNION ALL SELECT '/datasets/labels.jsonl', string_agg('id label '||CASE i % 3 WHEN 0 THEN 'setosa' WHEN 1 THEN 'versicolor' ELSE 'virginica' END||' petal_length sepal_length', ' ' ORDER BY i) FROM range(10) t(i)")
def sample_volume(s, d):
    """The sample volume's files and the text that is taken from each."""
    from lakeloom.functions.text import extract_text
    from lakeloom.sources.backends import sample_volume as made

    f = s.createDataFrame([(p, bytearray(b)) for p, b in made()], "path string, content binary")
    text = F.trim(F.regexp_replace(extract_text(F.col("path"), F.col("content")), "\\n$", ""))
    return f.select("path", text.alias("text"))
