"""Removal of passages that repeat across documents, byte by byte, found by anchors that their content places.

A gear rolling hash over 16 bytes orders the places of a text; the least of each window is an anchor, so a passage of
LEAST_RUN bytes has one, at the same place in it wherever it stands. An anchor that an earlier document (by doc_id) has
is a candidate: the earliest one sends the bytes around it, and the match is extended left and right to where the two
texts part. Matches of at least a given length in one earlier document are removed, and that document keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.runtime import materialize, record, small_batches, texts, tidy

#: A chunk ends where the hash is below this: one place in 32.
CUT_BELOW = (1 << 16) // 32
#: Bytes of a match that is removed; shorter ones occur by chance.
LEAST_RUN = 100
#: Bytes of an anchor; its place hangs on the first 16.
GRAM = 40
#: Bytes after which a document's repeated stretch is sent as a further piece.
PIECE = 512
#: Places of which the least ones are found at once.
BLOCK = 1 << 16
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
ANCHORS = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64())])
PACKED = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])
PIECES = pa.schema([("piece", pa.int64()), ("first", pa.int64()), ("copy", pa.int64()), ("start", pa.int64()), ("data", pa.binary()), ("places", pa.list_(pa.int32())), ("digests", pa.list_(pa.int64()))])
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_SPACE = frozenset(b"\t\n\v\f\r ")


def rolling(b: np.ndarray) -> np.ndarray:
    """The hash of the last 16 bytes at each place."""
    h = GEAR[b]
    for k in range(4):  # the last 2, 4, 8, 16 bytes
        d = 1 << k
        h[d:] = h[d:] + (h[:-d] << np.uint16(d))
    return h


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of UTF-8 text; the last one is its length. None is within a character."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(rolling(b)[:-1] < CUT_BELOW) + 1
    ends = ends[(b[ends] & 0xC0) != 0x80]
    return np.append(ends, len(b))


def chunk_digests(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ends, digests) of a text's chunks."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = cuts(data)
    digest, at, out = xxhash.xxh3_64_intdigest, 0, []
    for e in ends.tolist():
        out.append(digest(data[at:e]))
        at = e
    return ends, np.array(out, np.uint64).view(np.int64)


def anchors(data: bytes, least: int) -> np.ndarray:
    """Starts of the anchors: of the grams in each stretch of that many bytes, the leftmost with the least hash."""
    if len(data) < least:
        return np.zeros(0, np.int64)
    window = least - GRAM + 1
    h = rolling(np.frombuffer(data, np.uint8))[15 : len(data) - GRAM + 16]
    found = []
    for at in range(0, len(h) - window + 1, BLOCK - window + 1):
        v = h[at : at + BLOCK]
        m, d = v.astype(np.uint32) << np.uint32(16) | np.arange(len(v), dtype=np.uint32), 1
        while 2 * d <= window:
            m, d = np.minimum(m[:-d], m[d:]), 2 * d
        if d < window:
            m = np.minimum(m[: len(m) - (window - d)], m[window - d :])
        m = m & np.uint32(0xFFFF)
        found.append(m[np.flatnonzero(np.diff(m, prepend=m[0] + np.uint32(1)))].astype(np.int64) + at)
    return np.unique(np.concatenate(found))


def anchor_digests(data: bytes, places: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[p : p + GRAM]) for p in places.tolist()], np.uint64).view(np.int64)


def pieces(data: bytes, wanted: np.ndarray, least: int) -> Iterator[tuple[int, bytes, list[int], list[int]]]:
    """(start, bytes, places in them, digests) of a text's stretches around the anchors with wanted digests, in which
    each match of that many bytes over such an anchor lies. An anchor of like surroundings is not repeated."""
    places = anchors(data, least)
    digests = anchor_digests(data, places)
    seen, lo, hi, at, held = set(), 0, -1, [], []
    chosen = np.isin(digests, wanted)
    for p, x in zip(places[chosen].tolist(), digests[chosen].tolist(), strict=True):
        a, b = max(0, p + GRAM - least), min(len(data), p + least)
        around = (data[a:b], p - a)
        if around in seen:
            continue
        seen.add(around)
        if a > hi or b - lo > PIECE:
            if at:
                yield lo, data[lo:hi], at, held
            lo, at, held = a, [], []
        hi = b
        at.append(p - lo)
        held.append(x)
    if at:
        yield lo, data[lo:hi], at, held


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first values agree."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    i = int(differ.argmax()) if n else 0
    return i if n and differ[i] else n


def matches(data: bytes, sent: list[dict], least: int) -> list[tuple[int, int, int]]:
    """(start, end, first) of the matches of at least that many bytes with the pieces of one earlier text, each
    extended to where the two part."""
    grams: dict[bytes, list[int]] = {}
    for p in anchors(data, least).tolist():
        grams.setdefault(data[p : p + GRAM], []).append(p)
    whole = np.frombuffer(data, np.uint8)
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for x in sent:
        piece, reached = np.frombuffer(x["data"], np.uint8), {}
        for q in x["places"]:
            for p in grams.get(x["data"][q : q + GRAM], ()):
                if reached.get(p - q, -1) >= p:
                    continue
                a = p - _agree(whole[max(0, p - q) : p][::-1], piece[:q][::-1])
                b = p + GRAM + _agree(whole[p + GRAM : p + len(piece) - q], piece[q + GRAM :])
                reached[p - q] = b
                runs.setdefault((x["first"], x["copy"], p - q - x["start"]), []).append((a, b))
    out = []
    for (first, _, _), found in runs.items():
        found.sort()
        start, end = found[0]
        for a, b in [*found[1:], (len(data) + 1, 0)]:
            if a <= end:
                end = max(end, b)
                continue
            if end - start >= least:
                out.append((start, end, first))
            start, end = a, b
    return sorted(out)


def removed_spans(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Byte spans (start, end) of the matches together, without parts of characters at their ends; white space before one
    stays."""
    out = []
    for a, b, _ in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    for i, (a, b) in enumerate(out):
        while a < b and (data[a] & 0xC0 == 0x80 or 0 < a and data[a] in _SPACE):
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out[i] = a, b
    return [(a, b) for a, b in out if a < b]


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): compressed texts for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield record(PACKED, doc_id=batch.column("doc_id"), packed=[pack(t.encode()) for t in texts(batch)])

    return docs.mapInArrow(tidy(run), "doc_id long, packed binary")


def repeated_pieces(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, repeats): the pieces of earlier documents, with places of anchors, that a document shares an anchor with.

    Counts are combined before the shuffle, and the joins back to documents can be split where an anchor is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(anchor_digests(data, anchors(data, least))) for data in (t.encode() for t in texts(batch))]
            ids = batch.column("doc_id").to_numpy()
            yield record(ANCHORS, digest=np.concatenate(found) if found else [], doc_id=np.repeat(ids, [len(x) for x in found]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for i, packed, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), batch.column("wanted"), strict=True):
                data = unpack(packed)
                copy = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                for start, part, places, digests in pieces(data, wanted.values.to_numpy(), least):
                    rows.append((xxhash.xxh3_64_intdigest(b"%d %d %d" % (i, copy, start)) - (1 << 63), i, copy, start, part, places, digests))
            yield record(PIECES, **dict(zip(PIECES.names, zip(*rows, strict=True) if rows else [()] * len(PIECES), strict=True)))

    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    found = docs.mapInArrow(tidy(run), "digest long, doc_id long")
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    wanted = firsts.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("digest").alias("wanted"))
    sent = _packed(docs).join(wanted, "doc_id").select("doc_id", "packed", "wanted").mapInArrow(tidy(send), "piece long, first long, copy long, start long, data binary, places array<int>, digests array<long>")
    sent = materialize(sent, "pieces")
    keys = sent.select(F.explode("digests").alias("digest"), "first", "piece")
    later = found.join(keys, "digest").filter("doc_id > first").select("doc_id", "piece").distinct()
    parts = sent.select("piece", F.struct("first", "copy", "start", "data", "places").alias("part"))
    return later.join(parts, "piece").groupBy("doc_id").agg(F.collect_list("part").alias("repeats"))


def remove_repeats(docs: DataFrame, least: int = LEAST_RUN, only_changed: bool = False) -> DataFrame:
    """docs (doc_id, text and others) with repeated passages taken out of text, and _n_removed (characters), _spans
    (start and length in characters of the whole text) and _first_ids (the documents that keep them) added; only
    documents that lose something with only_changed.

    The document with the least doc_id keeps a passage; repeats within one document stay. A match counts from `least`
    bytes, more than GRAM, that one earlier document has in a row. A null or empty text stays as it is, and so does a
    row with a null doc_id. Rows with the same doc_id are one document and don't repeat each other. A copy of an earlier
    document of so many bytes loses all its text. An empty table gives no rows."""
    if least <= GRAM:
        raise ValueError(f"least must be over {GRAM}")
    small_batches(docs.sparkSession)
    repeats = materialize(repeated_pieces(docs, least), "repeats")
    joined = docs.join(repeats.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "inner" if only_changed else "left").drop("_id")
    schema = docs.schema
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, spans, firsts = [], [], []
            for text, sent in zip(batch.column("text").to_pylist(), batch.column("repeats"), strict=True):
                data = text.encode() if text and sent.is_valid else b""
                found = matches(data, sent.as_py(), least) if data else []
                kept, at, chars = [], 0, []
                for a, b in removed_spans(data, found):
                    kept.append(data[at:a])
                    chars.append({"start": len(data[:a].decode()), "length": len(data[a:b].decode())})
                    at = b
                new.append(b"".join([*kept, data[at:]]).decode() if chars else text)
                spans.append(chars)
                firsts.append(sorted({f for _, _, f in found}))
            columns = [pa.array(new, pa.string()) if i == text_at else batch.column(i) for i in range(len(schema))]
            columns += [pa.array([sum(s["length"] for s in x) for x in spans], pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, "_n_removed", "_spans", "_first_ids"])

    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _n_removed long, _spans array<struct<start:long,length:long>>, _first_ids array<long>"
    out = joined.mapInArrow(tidy(run), out_schema)
    return out.filter("_n_removed > 0") if only_changed else out
