"""Queries on the text of files: types, extraction, encodings, hashes, previews."""

from __future__ import annotations

import hmac
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.plans.registry import FILES, docs, files, query
from lakeloom.sources import fixtures as X

_A, _B = "coalesce(source, '-')", "coalesce(lang, '-')"
_SOURCE_LANG = f"{_A}||' '||{_B}"


# Types and extraction ------------------------------------------------------------------------------------------------
@query("SELECT event_id, 'a '||event_type||' b c u'||user_id||' n' AS strings FROM events")
def extract_json_strings(s, d):
    """Keys and strings of nested JSON, depth first; numbers are dropped."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    nested = F.to_json(F.struct(F.struct(user.alias("c")).alias("b"), F.array("event_type").alias("a"), F.col("event_id").alias("n")))
    return X.table(s, d, "events").select("event_id", T.extract_json(nested).alias("strings"))


@query("SELECT doc_id, sha256(array_to_string([trim(x, ' ') FOR x IN regexp_split_to_array(replace(text, ' ', chr(9)), '[\\t\\n]') IF trim(x, ' ') <> ''], ' ')) AS cells FROM documents")
def extract_tsv_cells(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.csv_cells(F.translate("text", " ", "\t"), "\t"), 256).alias("cells"))


_NAMES = ("safetensors", "parquet", "arrow", "zarr", "json", "jsonl", "PY", "rs", "bin", "none")
_TYPES = ("safetensors", "parquet", "arrow", "zarr", "json", "jsonl", "python", "rust", "binary", "binary")


@query("SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TYPES)) + " END AS type FROM documents")
def content_type(s, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 10 + 1).cast("int"))
    return docs(s, d).select("doc_id", T.content_type(F.concat(F.lit("/a.b/x."), name)).alias("type"))


def _bytes(hx: str) -> str:
    d = lambda k: f"(instr('0123456789ABCDEF', substr({hx}, {k}, 1)) - 1)"
    return f"list_transform(range(0, least(length({hx}) // 2, 1024)), lambda i: {d('2 * i + 1')} * 16 + {d('2 * i + 2')})"


@query(f"WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN hex(encode(text)) WHEN 1 THEN upper(sha256(text)) ELSE hex(encode(substr(text, 1, doc_id % 60)))||upper(sha256(text)) END AS hx FROM documents), b AS (SELECT doc_id, {_bytes('hx')} AS bs FROM x) SELECT doc_id, len(list_filter(bs, lambda b: NOT (b BETWEEN 33 AND 126 OR b IN (9, 10, 12, 13, 32)))) * 10 < len(bs) * 3 AS is_text FROM b")
def looks_like_text(s, d):
    """Texts, hashes, and texts with a hash at their end."""
    text, digest, n = F.col("text").cast("binary"), F.unhex(F.sha2("text", 256)), F.col("doc_id") % 3
    mixed = F.concat(F.substr("text", F.lit(1), (F.col("doc_id") % 60).cast("int")).cast("binary"), digest)
    return docs(s, d).select("doc_id", T.looks_like_text(F.when(n == 0, text).when(n == 1, digest).otherwise(mixed)).alias("is_text"))


def _archive(name: str, content: str) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, content)
    return b.getvalue()


def _table_file(kind: str, names: list[str]) -> bytes:
    import pyarrow as pa
    import pyarrow.parquet as pq

    b, t = io.BytesIO(), pa.table({n: [1] for n in names})
    if kind == "parquet":
        pq.write_table(t, b)
    else:
        with pa.ipc.new_file(b, t.schema) as w:
            w.write_table(t)
    return b.getvalue()


#: By suffix: a file that holds a document's source and language, and the text that is taken from it.
_FORMATS = {
    "txt": (lambda a, b: f"{a} {b}".encode(), _SOURCE_LANG),
    "MD": (lambda a, b: f"{a} {b}".encode() + b"\xff", _SOURCE_LANG + "||chr(65533)"),
    "json": (lambda a, b: json.dumps({"k": a, "j": [b, 1, None]}).encode(), f"'j '||{_B}||' k '||{_A}"),
    "jsonl": (lambda a, b: f'{{"k": "{a}"}}\nbad\n{{"k": "{b}"}}'.encode(), f"'k '||{_A}||' k '||{_B}"),
    "csv": (lambda a, b: f"{a}, {b}\n,{a}".encode(), _SOURCE_LANG + f"||' '||{_A}"),
    "tsv": (lambda a, b: f"{a}\t{b}, x".encode(), _SOURCE_LANG + "||', x'"),
    "docx": (lambda a, b: _archive("word/document.xml", f"<d><t>{a}</t><t> {b} </t></d>"), _SOURCE_LANG),
    "xlsx": (lambda a, b: _archive("xl/sharedStrings.xml", f"<s><si><t>{a}</t></si><si><t>{b}</t></si></s>"), _SOURCE_LANG),
    "pptx": (lambda a, b: _archive("ppt/slides/slide1.xml", f"<s><t>{a}</t><t>{b}</t></s>"), _SOURCE_LANG),
    "pdf": (lambda a, b: f"%PDF stream BT ({a}) Tj <{b.encode().hex()}> Tj ET endstream".encode(), _SOURCE_LANG),
    "zarr": (lambda a, b: _archive("x/.zattrs", json.dumps({"lang": b, "by": a, "n": 1})), f"'by '||{_A}||' lang '||{_B}||' n'"),
    "parquet": (lambda a, b: _table_file("parquet", [f"a_{a}", f"b_{b}"]), f"'a_'||{_A}||' b_'||{_B}"),
    "arrow": (lambda a, b: _table_file("arrow", [f"a_{a}", f"b_{b}"]), f"'a_'||{_A}||' b_'||{_B}"),
    "png": (lambda a, b: f"{a} {b}".encode(), "''"),
    "mp3": (lambda a, b: f"{a} {b}".encode(), "''"),
    "gguf": (lambda a, b: f"{a} {b}".encode(), "''"),
    "unknown": (lambda a, b: f"{a} {b}".encode(), _SOURCE_LANG),
    "odd": (lambda a, b: f"{a} {b}".encode() + bytes(range(128, 228)), "''"),
}


def _typed_files(s, d):
    """path, content: a file of one of the formats for each document."""
    kinds = list(_FORMATS)
    made = F.pandas_udf(lambda n, a, b: pd.Series([_FORMATS[kinds[k]][0](x, y) for k, x, y in zip(n, a, b, strict=True)]), "binary")
    k = (F.col("doc_id") % len(kinds)).cast("int")
    path = F.concat(F.lit("/f/"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, kinds)), k + 1))
    return docs(s, d).select("doc_id", path.alias("path"), made(k, F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))).alias("content"))


@query(f"SELECT doc_id, CASE doc_id % {len(_FORMATS)} " + " ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(_FORMATS.values())) + " END AS text FROM documents")
def extract_dispatch(s, d):
    """The text of files of every format, by their suffixes."""
    return _typed_files(s, d).select("doc_id", T.extract_text(F.col("path"), F.col("content")).alias("text"))


@query(f"SELECT doc_id, {_SOURCE_LANG} AS strings FROM documents")
def extract_identifiers(s, d):
    """Texts with their lengths before them, among other bytes."""
    size = lambda c: F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 8, "0"))
    a, b = F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))
    a, b = F.when(a == "-", "_").otherwise(a), F.when(b == "-", "_").otherwise(b)
    junk = F.unhex(F.lit("FFFEFD"))
    content = F.concat(junk, size(a), a.cast("binary"), junk, junk, size(b), b.cast("binary"), junk)
    scan = F.pandas_udf(lambda c: c.map(lambda x: T.identifier_strings(bytes(x))), "string")
    return docs(s, d).select("doc_id", F.translate(scan(content), "_", "-").alias("strings"))


# Encodings, hashes, previews -----------------------------------------------------------------------------------------
@query("WITH t AS (SELECT doc_id, substr(text, 1, 60) AS h FROM documents) SELECT doc_id, array_to_string([CASE WHEN regexp_matches(c, '^[A-Za-z0-9\\-_.~/]$') THEN c ELSE '%'||format('{:02X}', unicode(c)) END FOR c IN string_split(h, '')], '') AS encoded, replace(replace(h, ':', '%3A'), '/', '%2F') AS colons FROM t")
def percent_encode(s, d):
    head = F.substr("text", F.lit(1), F.lit(60))
    return docs(s, d).select("doc_id", T.percent_encode(head).alias("encoded"), F.replace(F.replace(head, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")).alias("colons"))


_KEY = b"a key of some length"
_PADS = ["".join(f"{b ^ x:02X}" for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f"SELECT doc_id, sha256(unhex('{_PADS[1]}')||unhex(sha256(unhex('{_PADS[0]}')||encode(text)))) AS mac FROM documents")
def hmac_hex(s, d):
    assert hmac.new(_KEY, b"x", "sha256").hexdigest() == s.range(1).select(T.hmac_sha256(_KEY, F.lit("x").cast("binary"))).first()[0]
    return docs(s, d).select("doc_id", T.hmac_sha256(_KEY, F.col("text").cast("binary")).alias("mac"))


@query(f"WITH {FILES} SELECT path, substring(hash, 1, 12) AS short, doc_id % 4 <> 0 AS valid, hash AS whole FROM files")
def hash_hex(s, d):
    """Hashes cut short, read back from hexadecimal (some with a wrong digit), and made of a content's parts."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.substring("hash", 1, 63), F.lit("g"))).otherwise(F.upper("hash"))
    data, n = F.col("text").cast("binary"), F.octet_length("text")
    parts = F.array(F.substr(data, F.lit(1), F.floor(n / 2).cast("int")), F.substr(data, F.floor(n / 2).cast("int") + 1, n))
    return files(s, d).select("path", F.substring("hash", 1, 12).alias("short"), T.from_hex(text).isNotNull().alias("valid"), T.hash_parts(parts).alias("whole"))


@query(f"WITH x AS (SELECT doc_id, lower(hex(encode(substr(text, 1, 60)))) AS a FROM documents), h AS (SELECT doc_id, substr(a, 1, 512) AS hx FROM x), r AS (SELECT doc_id, hx, i FROM h, unnest(range(0, (length(hx) + 31) // 32)) u(i)), b AS (SELECT doc_id, i, rpad(array_to_string([substr(hx, CAST(i * 32 + 2 * k + 1 AS BIGINT), 2) FOR k IN range(0, least(16, (length(hx) - i * 32) // 2))], ' '), 47, ' ')||'  '||array_to_string([CASE WHEN v BETWEEN 32 AND 126 THEN chr(v) ELSE '.' END FOR v IN [CAST((instr('0123456789abcdef', substr(hx, CAST(i * 32 + 2 * k + 1 AS BIGINT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(hx, CAST(i * 32 + 2 * k + 2 AS BIGINT), 1)) - 1 AS INTEGER) FOR k IN range(0, least(16, (length(hx) - i * 32) // 2))]], '') AS line FROM r) SELECT x.doc_id, 'Binary ('||length(a) // 2||' bytes)'||chr(10)||coalesce(string_agg(line, chr(10) ORDER BY i), '') AS shown FROM x LEFT JOIN b ON x.doc_id = b.doc_id GROUP BY x.doc_id, a")
def preview_binary(s, d):
    content = F.substr("text", F.lit(1), F.lit(60)).cast("binary")
    return docs(s, d).select("doc_id", T.preview(F.lit("/x/unknown"), content).alias("shown"))


def _tensor_file(x) -> bytes:
    spec = lambda a, b: {"dtype": "F32", "shape": [b - a], "data_offsets": [4 * a, 4 * b]}
    head = json.dumps({"e": spec(0, len(x)), "f": spec(len(x), len(x) + 2), "__metadata__": {"k": "v"}}).encode()
    return len(head).to_bytes(8, "little") + head + bytes(4 * len(x) + 8)


_HEAD = """strlen('{"e": {"dtype": "F32", "shape": ['||n||'], "data_offsets": [0, '||4 * n||']}, "f": {"dtype": "F32", "shape": [2], "data_offsets": ['||4 * n||', '||4 * n + 8||']}, "__metadata__": {"k": "v"}}')"""


def _tensors(s, d):
    made = F.pandas_udf(lambda v: v.map(_tensor_file), "binary")
    return X.table(s, d, "embeddings").select("vec_id", made("embedding").alias("content"))


@query(f"WITH k AS (SELECT vec_id, len(embedding) AS n FROM embeddings), h AS (SELECT *, 8 + {_HEAD} AS a FROM k) SELECT vec_id, 'e' AS name, 'F32' AS dtype, n AS elements, a AS first, a + 4 * n AS last FROM h UNION ALL SELECT vec_id, 'f', 'F32', 2, a + 4 * n, a + 4 * n + 8 FROM h")
def safetensors_tensors(s, d):
    """A row for each tensor of files that hold two, with its absolute byte range."""
    rows = F.pandas_udf(lambda c: c.map(lambda b: [{"name": n, "dtype": t, "elements": int(pd.Series(shape).prod()), "first": i, "last": j} for n, t, shape, i, j in T.tensor_header(bytes(b))]), "array<struct<name:string,dtype:string,elements:long,first:long,last:long>>")
    return _tensors(s, d).select("vec_id", F.inline(rows("content")))


@query(f"WITH k AS (SELECT vec_id, len(embedding) AS n FROM embeddings), h AS (SELECT *, 8 + {_HEAD} AS a FROM k) SELECT vec_id, a + 4 * n AS first, a + 4 * n + 8 AS last, 'e F32 '||n||chr(10)||'f F32 2' AS shown FROM h")
def safetensors_by_name(s, d):
    """The byte range of one tensor by its name, and what a preview shows."""
    f = _tensors(s, d)
    rows = safetensors_tensors(s, d).filter("name = 'f'").select("vec_id", "first", "last")
    return f.select("vec_id", T.preview(F.lit("/m.safetensors"), F.col("content")).alias("shown")).join(rows, "vec_id")
