"""Text of files: extensions, content types, extraction."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types by suffix; any other is binary.
TYPES = {"safetensors": "safetensors", "parquet": "parquet", "arrow": "arrow", "zarr": "zarr", "json": "json", "jsonl": "jsonl", "py": "python", "rs": "rust"}


def extension(path: Column) -> Column:
    """Text after the last dot of the last segment, without ?..., in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"\?.*$", ""), r"\.([^./]*)$", 1))


def content_type(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), extension(path)), F.lit("binary"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*(>|$)", ""), ">", "")


def csv_cells(text: Column, delimiter: str = ",") -> Column:
    cells = F.transform(F.split(text, f"[{delimiter}\n]"), lambda x: F.trim(x))
    return F.array_join(F.filter(cells, lambda x: x != ""), " ")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def looks_like_text(content: Column) -> Column:
    """Less than three tenths of the first 1,024 bytes are neither printable ASCII nor white space; empty is not text."""
    head = F.decode(F.substr(content, F.lit(1), F.lit(1024)), "ISO-8859-1")
    odd = F.char_length(head) - F.char_length(F.regexp_replace(head, r"[^\x21-\x7E \t\n\f\r]", ""))
    return odd * 10 < F.char_length(head) * 3


def percent_encode(text: Column, keep: str = r"[A-Za-z0-9\-_.~/]") -> Column:
    """Each other character as % and its code point in hexadecimal, two digits at least."""
    code = lambda c: F.hex(F.ascii(c).cast("long"))
    one = lambda c: F.when(c.rlike(f"^{keep}$"), c).otherwise(F.concat(F.lit("%"), F.when(F.length(code(c)) < 2, F.concat(F.lit("0"), code(c))).otherwise(code(c))))
    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def hex_dump(content: Column, most: int = 256) -> Column:
    """The first bytes in rows of sixteen, in hexadecimal and as ASCII with a dot for what can't be shown."""
    head = F.substr(content, F.lit(1), F.lit(most))
    shown, digits = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x20-\x7E]", "."), F.lower(F.hex(head))
    pairs = lambda i: F.rpad(F.regexp_replace(F.substr(digits, i * 32 + 1, F.lit(32)), "(..)(?!$)", "$1 "), 47, " ")
    row = lambda i: F.concat(pairs(i), F.lit("  "), F.substr(shown, i * 16 + 1, F.lit(16)))
    n = F.octet_length(head)
    return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), row), "\n"))


def preview(path: Column, content: Column) -> Column:
    """A short description of a file by its type: tensors of a safetensors file, what marks a Parquet or Arrow file, text of
    Zarr descriptions, else the size and a dump of the first bytes."""
    size = F.octet_length(content).cast("string")
    kind = content_type(path)
    table = F.pandas_udf(lambda c: c.map(lambda b: None if b is None else _tensor_lines(bytes(b))), "string")
    parquet = F.when(F.substr(content, F.lit(1), F.lit(4)) == F.lit("PAR1").cast("binary"), F.concat(F.lit("Parquet: "), size, F.lit(" bytes"))).otherwise("not a Parquet file")
    out = F.when(kind == "safetensors", table(F.when(kind == "safetensors", content))).when(kind == "parquet", parquet).when(kind == "arrow", F.concat(F.lit("Arrow: "), size, F.lit(" bytes")))
    return out.when(kind == "zarr", F.concat(F.lit("Zarr: "), xml_escape(utf8(content)))).otherwise(F.concat(F.lit("Binary ("), size, F.lit(" bytes)\n"), hex_dump(content)))


def _tensor_lines(data: bytes) -> str:
    try:
        return "\n".join(f"{n} {t} {' x '.join(map(str, shape))}" for n, t, shape, _, _ in tensor_header(data))
    except (ValueError, KeyError, AttributeError):
        return "not a safetensors file"


def hash_parts(parts: Column) -> Column:
    """SHA-256 of an array of contents one after the other, as a running hash over them gives it."""
    return F.sha2(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), "")), 256)


def from_hex(text: Column) -> Column:
    """The 32 bytes of a hash in hexadecimal; null for any other text."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a message's bytes, in lower-case hexadecimal."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def json_strings(value) -> list[str]:
    """Keys and string values, depth first; other values are dropped."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for v in value for s in json_strings(v)]
    if isinstance(value, dict):
        return [s for k in sorted(value) for s in [k, *json_strings(value[k])]]
    return []


def _json_series(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return " ".join(json_strings(json.loads(t)))
        except ValueError:
            return t

    return text.map(one)


def extract_json(text: Column) -> Column:
    """Keys and string values of a JSON text, joined by spaces; a text that is no JSON stays."""
    return F.pandas_udf(_json_series, "string")(text)


def extract_jsonl(text: str) -> str:
    """extract_json line by line; lines that are no JSON are dropped."""
    out = []
    for line in text.split("\n"):
        try:
            out += json_strings(json.loads(line))
        except ValueError:
            continue
    return " ".join(out)


def office_text(data: bytes) -> str:
    """Text nodes of a word, sheet or slide archive."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if re.fullmatch(r"word/document\.xml|xl/sharedStrings\.xml|ppt/slides/slide\d+\.xml", name):
                    out += [t.strip() for t in ElementTree.fromstring(z.read(name)).itertext() if t.strip()]
    except (zipfile.BadZipFile, ElementTree.ParseError, zlib.error):
        return ""
    return " ".join(out)


def pdf_text(data: bytes) -> str:
    """Literal and hexadecimal strings between BT and ET in streams that aren't compressed."""
    out = []
    for block in re.findall(rb"BT(.*?)ET", data, re.S):
        for literal, hexa in re.findall(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>", block):
            raw = re.sub(rb"\\(.)", rb"\1", literal) if literal else bytes.fromhex(re.sub(rb"\s", b"", hexa).decode().ljust(2, "0")[: len(re.sub(rb"\s", b"", hexa)) // 2 * 2])
            out.append(raw.decode("utf-8", "replace").strip())
    return " ".join(x for x in out if x)


def tensor_header(data: bytes) -> list[tuple[str, str, list[int], int, int]]:
    """name, dtype, shape, start, end of each tensor in a safetensors file; absolute bytes."""
    n = int.from_bytes(data[:8], "little")
    if len(data) < 8 + n:
        raise ValueError("short header")
    head = json.loads(data[8 : 8 + n])
    return [(k, v["dtype"], v["shape"], 8 + n + v["data_offsets"][0], 8 + n + v["data_offsets"][1]) for k, v in sorted(head.items()) if k != "__metadata__"]


def zarr_text(data: bytes) -> str:
    """Keys and strings of the array, group and attribute descriptions in a zip archive, or of a bare JSON description."""
    if data[:1] == b"{":
        return _json_text(data.decode("utf-8", "replace"))
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            wanted = [n for n in z.namelist() if n.endswith((".zarray", ".zattrs", "zarr.json"))]
            return " ".join(filter(None, (_json_text(z.read(n).decode("utf-8", "replace")) for n in wanted)))
    except (zipfile.BadZipFile, zlib.error):
        return ""


def _json_text(text: str) -> str:
    try:
        return " ".join(json_strings(json.loads(text)))
    except ValueError:
        return text


def identifier_strings(data: bytes) -> str:
    """Texts of letters, digits and _-. / that a big-endian length of four bytes stands before."""
    out, i = [], 0
    while i + 4 < len(data):
        n = int.from_bytes(data[i : i + 4], "big")
        part = data[i + 4 : i + 4 + n]
        if 0 < n <= 256 and len(part) == n and _IDENTIFIER.fullmatch(part):
            out.append(part.decode())
            i += 4 + n
        else:
            i += 1
    return " ".join(out).strip()


_IDENTIFIER = re.compile(rb"[A-Za-z0-9_][A-Za-z0-9_\-. /]*")


def parquet_names(data: bytes) -> str:
    """Column names of a Parquet file, from its footer."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    try:
        return " ".join(pq.read_schema(io.BytesIO(data)).names) if data[:4] == b"PAR1" else ""
    except (pa.ArrowException, OSError):
        return ""


def arrow_names(data: bytes) -> str:
    """Column names of an Arrow file."""
    import pyarrow as pa

    try:
        return " ".join(pa.ipc.open_file(io.BytesIO(data)).schema.names) if data[:6] == b"ARROW1" else ""
    except (pa.ArrowException, OSError):
        return ""


#: Suffixes of texts, and of files without any; extractors of the other formats by suffix.
TEXTS = "txt md rst log cfg ini env gitignore dockerignore rs py go ts js jsx tsx c cpp h java cs rb php swift kt scala sh bash zsh fish toml yaml yml xml html htm css scss sql".split()
NO_TEXT = "png jpg jpeg gif bmp webp tiff tif svg mp3 wav flac ogg m4a aac safetensors gguf ggml pt pth bin npz npy".split()
BINARY = {"docx": office_text, "doc": office_text, "xlsx": office_text, "xls": office_text, "pptx": office_text, "ppt": office_text, "pdf": pdf_text, "zarr": zarr_text, "parquet": parquet_names, "arrow": arrow_names, "ipc": arrow_names, "feather": arrow_names}


def extract_binary(content: Column, suffix: str) -> Column:
    """Text of files of a binary format; null content has none."""
    f = BINARY[suffix]
    return F.pandas_udf(lambda s: s.map(lambda b: "" if b is None else f(bytes(b))), "string")(content)


def extract_text(path: Column, content: Column) -> Column:
    """Text of a file by its suffix. Texts and tables are read without Python; only the contents of JSON and of binary formats
    go to it. A file of another suffix is text if it looks like it."""
    ext, text = extension(path), utf8(content)
    by_suffix = F.pandas_udf(lambda e, c: pd.Series([None if b is None or x not in BINARY else BINARY[x](bytes(b)) for x, b in zip(e, c, strict=True)]), "string")
    binary = ext.isin(*BINARY)
    out = F.when(content.isNull(), "").when(ext.isin(*TEXTS), text).when(ext.isin(*NO_TEXT), "")
    out = out.when(ext == "json", extract_json(F.when(ext == "json", text))).when(ext.isin("jsonl", "ndjson"), extract_json_lines(F.when(ext.isin("jsonl", "ndjson"), text)))
    out = out.when(ext == "csv", csv_cells(text)).when(ext == "tsv", csv_cells(text, "\t")).when(binary, by_suffix(ext, F.when(binary, content)))
    return out.when(looks_like_text(content), text).otherwise("")


def extract_json_lines(text: Column) -> Column:
    """extract_jsonl() of each text."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else extract_jsonl(t)), "string")(text)


def utf8(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
