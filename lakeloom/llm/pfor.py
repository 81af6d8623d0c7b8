"""Token ids in files of patched frame-of-reference blocks.

A file holds whole documents: a header, the documents' keys and lengths, a block index and the blocks. A block of 128 ids
stores the ids less their minimum, packed at the width that a fixed share of them needs; the high bits of the others
stand in an exception list after it. The index gives each block's start, so any block is read alone.

The files are written by Spark's own writer, one row a file, so they go to any file system that Spark reaches, and a
task that is lost and run again leaves none twice. The writer ends each with a line feed, which is no part of a block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.encode import encoder
from lakeloom.llm.runtime import materialize, record, scratch_path, small_batches, texts, tidy

BLOCK = 128
#: The share of a block's values that must fit the packed width; the rest become exceptions.
PERCENTILE = 90
#: Ids in a file: it closes with the document that reaches this.
IMAGE_IDS = 1 << 22
#: Blocks that are packed or unpacked at once.
RUN_BLOCKS = 512
MAGIC = b"LPF2"
#: Mark, documents, ids, blocks, part, and ids of the part before the file. Parts follow one another by number.
_HEADER = struct.Struct("<4sIQIIQ")

FILES = pa.schema([("image", pa.binary())])
ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(block index, payload) of uint32 ids. An index entry: byte start, minimum, width, number of exceptions."""
    step, indexes, payloads, at = RUN_BLOCKS * BLOCK, [], [], 0
    for k in range(0, len(ids), step):
        index, payload = _pack(ids[k : k + step])
        index["start"] += at
        indexes.append(index.tobytes())
        payloads.append(payload)
        at += len(payload)
    return b"".join(indexes), b"".join(payloads)


def _pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    need = _bits(rest)
    width = np.sort(need, axis=1)[:, BLOCK * PERCENTILE // 100 - 1] if blocks else np.zeros(0, np.int64)
    out = need > width[:, None]
    n_out = out.sum(axis=1)
    sizes = width * (BLOCK // 8) + n_out * 5
    starts = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            held = rest[rows].astype("<u2" if w <= 16 else "<u4")
            bits = np.unpackbits(held.view(np.uint8).reshape(len(rows), BLOCK, -1), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            payload[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(out)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_out)])[row]
        at = starts[row] + width[row] * (BLOCK // 8) + nth * 5
        payload[at] = place
        high = (rest[row, place] >> width[row].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        payload[at[:, None] + 1 + np.arange(4)] = high
    index = np.zeros(blocks, dtype=INDEX)
    index["start"], index["least"], index["width"], index["n_out"] = starts[:-1], least, width, n_out
    return index, payload.tobytes()


INDEX = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("n_out", "u1")])


def unpack(index: np.ndarray, payload: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first to last - 1."""
    index = index[first:last]
    parts = [_unpack(index[k : k + RUN_BLOCKS], payload) for k in range(0, len(index), RUN_BLOCKS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _unpack(index: np.ndarray, payload: np.ndarray) -> np.ndarray:
    full = np.zeros((len(index), BLOCK), np.uint32)
    start, width, n_out = (index[k].astype(np.int64) for k in ("start", "width", "n_out"))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = payload[start[rows][:, None] + np.arange(w * (BLOCK // 8))]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            value = np.zeros((len(rows), BLOCK), np.uint32)
            for k in range(w):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            full[rows] = value
    row = np.repeat(np.arange(len(index)), n_out)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_out)])[row]
        at = start[row] + width[row] * (BLOCK // 8) + nth * 5
        high = payload[at[:, None] + 1 + np.arange(4)].copy().view("<u4")[:, 0]
        full[row, payload[at]] |= high << width[row].astype(np.uint32)
    return (full + index["least"][:, None]).reshape(-1)


def write_image(keys: list[int | None], lengths: list[int], ids: np.ndarray, part: int = 0, start: int = 0) -> bytes:
    """The bytes of a file of whole documents; a null key is kept as null."""
    index, payload = pack(ids)
    known = np.packbits(np.array([k is not None for k in keys], np.uint8)).tobytes()
    return b"".join([_HEADER.pack(MAGIC, len(keys), len(ids), len(index) // INDEX.itemsize, part, start), known, np.array([k or 0 for k in keys], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), index, payload])


def image_place(image: bytes) -> tuple[int, int]:
    """(part, ids of the part before it) of a file."""
    return _HEADER.unpack_from(image)[4:]


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, lengths, ids) of a file."""
    magic, docs, n, blocks, _, _ = _HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEADER.size
    known = np.unpackbits(np.frombuffer(image, np.uint8, -(-docs // 8), at))[:docs]
    at += -(-docs // 8)
    keys, lengths = np.frombuffer(image, "<i8", docs, at), np.frombuffer(image, "<u8", docs, at + 8 * docs)
    at += 16 * docs
    index = np.frombuffer(image, INDEX, blocks, at)
    ids = unpack(index, np.frombuffer(image, np.uint8, offset=at + blocks * INDEX.itemsize))[:n]
    return [int(k) if ok else None for k, ok in zip(keys, known, strict=True)], lengths.astype(np.int64), ids


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> str:
    """Encode every whole text of docs (doc_id, text; null: empty), append end_id, and write the ids to files in ascending
    doc_id order (null first; rows with one doc_id, or none, by the xxhash64 of the text). Returns the folder: a new one
    in the shared scratch folder, unless one is given.

    One range shuffle of the texts, by both columns, so that rows without a doc_id are dealt too; a task holds one file's
    ids. An empty table gives no file."""
    spark = docs.sparkSession
    small_batches(spark)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        keys, found, held, start = [], [], 0, 0

        def image():
            lengths, ids = [len(x) // 4 for x in found], np.frombuffer(b"".join(found), "<u4")
            found.clear()
            return record(FILES, image=[write_image(keys, lengths, ids, part, start)])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                keys.append(key)
                found.append(enc.encode(text) + end)
                held += len(found[-1]) // 4
                if held >= IMAGE_IDS:
                    yield image()
                    keys, found, start, held = [], [], start + held, 0
        if keys:
            yield image()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    most = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    # ids that don't repeat part the rows alone, so that the texts need not be read for the bounds of the ranges
    ordered = rows.repartitionByRange(*(["doc_id", "_h"] if most > 1 else ["doc_id"])).sortWithinPartitions("doc_id", "_h")
    folder = folder or scratch_path(spark, "token files")
    images = ordered.select("doc_id", "text").mapInArrow(tidy(encode), "image binary")
    images.select(F.col("image").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files in a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                image = content.as_buffer()
                part, start = image_place(image)
                keys, lengths, ids = read_image(image)
                ends = np.cumsum(lengths)
                raw, starts = memoryview(ids.astype("<u4").tobytes()), ends - lengths
                yield record(ROWS, doc_id=keys, part=np.full(len(keys), part), at=start + starts, n_tokens=lengths, ids_crc32=[zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0").select("content")
    rows = materialize(files.mapInArrow(tidy(decode), "doc_id long, part long, at long, n_tokens long, ids_crc32 long"), "token rows")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.selectExpr("part", "sum(n) over (order by part) - n as base")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
