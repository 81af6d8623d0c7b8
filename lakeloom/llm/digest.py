"""Document fingerprints: a wide digest of the canonical text, with a byte comparison of texts that share one."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.runtime import materialize, record, small_batches, texts, tidy

ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DEALT = pa.schema([("bucket", pa.int32()), ("tail", pa.int32()), ("k", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
SHARED = pa.schema([("fingerprint", pa.string()), ("packed", pa.binary())])
#: A null doc_id comes before all others.
NULL_KEY = -(1 << 63)
#: Hexadecimal digits of a fingerprint that place it in the map of shared ones: 2**20 bits, whatever the data's size.
MAP_DIGITS = 5
#: Buckets at most, and keys whose quantiles part them.
MOST_BUCKETS, QUANTILE_KEYS = 1 << 16, 1 << 21
#: Bytes of canonical texts that a task remembers while it compares copies.
REMEMBERED = 32 << 20


def canonical(text: str) -> bytes:
    """Compatibility composition, case folding, and each run of white space as one space, none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def narrow(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def wide(data: bytes) -> str:
    """For a corpus in which two texts share a narrow digest."""
    return narrow(data) + hashlib.blake2b(data, digest_size=32).hexdigest()


def edit(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following one, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _deal(docs: DataFrame) -> DataFrame | None:
    """docs with packed texts, dealt to buckets that follow one another in doc_id order; the first document of each
    bucket stands also, as its tail, in the one before it, and the first of all in the last one."""
    spark = docs.sparkSession
    keys = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("k"))
    buckets = min(MOST_BUCKETS, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bound = 1 << 40  # quantiles of a share of the keys, so that what tasks send doesn't grow with their number
    share = min(bound, bound * QUANTILE_KEYS // max(keys.count(), 1))
    some = keys.filter(F.pmod(F.xxhash64("k"), F.lit(bound)) < share) if share < bound else keys
    cuts = some.approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    splits = np.unique(np.array(cuts, np.float64)).clip(-(2.0**63), 2.0**63 - 1024).astype(np.int64)

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            b = np.searchsorted(splits, k, side="right")
            order = np.lexsort((k, b))
            at = np.flatnonzero(np.diff(b[order], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(b[order][at], pa.int32()), pa.array(k[order][at])], names=["bucket", "k"])

    firsts = sorted(map(tuple, keys.mapInArrow(first_keys, "bucket int, k long").groupBy("bucket").agg(F.min("k")).collect()))
    if not firsts:
        return None
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                k, packed = NULL_KEY if i is None else i, pack(t.encode())
                rows.append((int(np.searchsorted(splits, k, side="right")), 0, k, i, packed))
                if k in before:
                    rows.append((before[k], 1, k, i, packed))
            yield record(DEALT, **dict(zip(DEALT.names, zip(*rows, strict=True) if rows else [()] * 5, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(tidy(deal), "bucket int, tail int, k long, doc_id long, packed binary").repartition("bucket").sortWithinPartitions("bucket", "tail", "k", "packed")


def _fingerprints(dealt: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, out = None, []
        for batch in chain(batches, [None]):
            rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "packed")), strict=True) if batch else []
            for bucket, tail, key, packed in rows:
                text = unpack(packed).decode()
                form = canonical(text)
                now = (bucket, key, text, form, digest(form))
                if held and held[0] == bucket:
                    edited = edit(held[2], text)
                    changed = canonical(edited)
                    out.append((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), held[4], digest(changed), float(changed == held[3]), float(form == held[3])))
                held = None if tail else now
            if out:
                yield record(ROWS, **dict(zip(ROWS.names, zip(*out, strict=True), strict=True)))
                out = []

    return dealt.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _collide(docs: DataFrame, found: DataFrame, digest: Callable[[bytes], str]) -> bool:
    """Whether different canonical texts share a fingerprint. Texts whose fingerprint occurs once are passed over, and
    so are copies that a task has compared already; the rest are compared byte by byte in aggregation."""
    shared = found.groupBy("fingerprint").count().filter("count > 1")
    places = shared.select(F.conv(F.substring("fingerprint", 1, MAP_DIGITS), 16, 10).cast("int").alias("p")).distinct().toPandas()["p"].to_numpy()
    if not len(places):
        return False
    bits = np.zeros(16**MAP_DIGITS, bool)
    bits[places] = True
    bits = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, marked, seen, held = zstandard.ZstdCompressor(level=1).compress, np.unpackbits(bits), {}, 0
        for batch in batches:
            rows = []
            for t in texts(batch):
                form = canonical(t)
                f = digest(form)
                if marked[int(f[:MAP_DIGITS], 16)] and seen.get(f) != form:
                    rows.append((f, pack(form)))
                    if held < REMEMBERED and f not in seen:
                        seen[f] = form
                        held += len(form)
            if rows:
                yield record(SHARED, **dict(zip(SHARED.names, zip(*rows, strict=True), strict=True)))

    different = docs.select("text").mapInArrow(tidy(run), "fingerprint string, packed binary").distinct().groupBy("fingerprint").count().filter("count > 1")
    return not different.isEmpty()


def fingerprint(docs: DataFrame, digest: Callable[[bytes], str] = narrow) -> DataFrame:
    """Per document of docs (doc_id, text; null: empty): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Fingerprints are equal if and only if the canonical texts are: if a corpus holds different ones that share the
    given digest, all are made anew with a wider one. The digest tells equal from different, so the likenesses are 1
    or 0. Repeated doc_ids follow one another by text, null ids come first; a table of one row is its own next
    document; an empty table gives no rows.

    One shuffle, of compressed texts, in doc_id order; the driver holds split points and a map of fixed size."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    dealt = _deal(docs)
    if dealt is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    found = materialize(_fingerprints(dealt, digest), "fingerprints")
    if _collide(docs, found, digest):
        found = materialize(_fingerprints(_deal(docs), wide), "wide fingerprints")
    return found
