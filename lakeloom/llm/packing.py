"""Packing of documents' token ids into sequences: large items are matched, at most two a sequence, and smaller ones
best-fit the gaps.

What matters for packing is only how many pieces have each length. So the plan is made from the histogram of lengths,
which has as many entries as a sequence has tokens, whatever the data's size: it lists kinds of sequences (the lengths
in them) and how many there are of each. Pieces then take their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.encode import encoder
from lakeloom.llm.runtime import materialize, record, small_batches, texts, tidy

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
#: Whole sequences of one piece are numbered from here, by task and place in it.
WHOLE_FROM = 1 << 61


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences, as (lengths in place order, how many), that hold all pieces of the histogram.

    Large-item matching: pieces above a third of the capacity stand at most twice in a sequence. From the largest on,
    each is matched with the largest other one that fits beside it. Then smaller pieces, from the largest on, take the
    smallest gap that holds them. Equal pieces and equal sequences are handled together, by number."""
    left = {n: k for n, k in histogram.items() if k}
    third = capacity // 3
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    order: list[int] = []

    def put(lengths: tuple[int, ...], many: int) -> None:
        gap = capacity - sum(lengths)
        if not gaps[gap]:
            insort(order, gap)
        gaps[gap][lengths] = gaps[gap].get(lengths, 0) + many

    large = sorted(n for n in left if n > third)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at < 0:
            put((n,), left[n])
            large.pop()
            continue
        m = large[at]
        many = left[n] // 2 if m == n else min(left[n], left[m])
        if many == 0:  # the last of its length has no other like it
            if at == 0:
                put((n,), left[n])
                large.pop()
                continue
            m = large[at - 1]
            many = min(left[n], left[m])
        put((n, m), many)
        for x in (n, m):
            left[x] -= many
        for x in {n, m}:
            if not left[x]:
                large.remove(x)
    for n in sorted((n for n in left if n <= third), reverse=True):
        many = left[n]
        while many:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                if many >= each:
                    put((n,) * each, many // each)
                else:
                    put((n,) * many, 1)
                many -= min(many, many // each * each or many)
                continue
            gap = order[at]
            lengths = next(iter(gaps[gap]))
            have = gaps[gap].pop(lengths)
            if not gaps[gap]:
                order.pop(at)
            fit = gap // n
            if many >= fit * have:
                put(lengths + (n,) * fit, have)
                many -= fit * have
            elif many >= fit:
                put(lengths + (n,) * fit, many // fit)
                put(lengths, have - many // fit)
                many -= fit * (many // fit)
            else:
                put(lengths + (n,) * many, 1)
                if have > 1:
                    put(lengths, have - 1)
                many = 0
    return [(lengths, many) for gap in order for lengths, many in gaps[gap].items()]


def places(kinds: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): the pieces from that rank on stand there, one a sequence
    as numbered from the first."""
    out, seen, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, many in kinds:
        offset = 0
        for n in lengths:
            out[n].append((seen[n], sequence, offset))
            seen[n] += many
            offset += n
        sequence += many
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def cut(ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits; else pieces of the capacity, the first one shorter where
    they don't come out even."""
    if ids <= capacity:
        return [(0, ids)]
    first = ids % capacity
    return [(0, first)] * bool(first) + [(k, capacity) for k in range(first, ids, capacity)]


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Per piece of docs (doc_id, text; null: empty): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each row is a document of its own, so repeated rows are packed as often as they occur. Every document has its end
    id at least, so an empty one is a piece of one token. An empty table gives no rows. Only piece lengths are
    shuffled, as counts by task; the driver sees one count for each length."""
    spark = docs.sparkSession
    small_batches(spark)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoder(vocabulary), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = enc.encode(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((key, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
            yield record(PIECES, **dict(zip(PIECES.names, zip(*rows, strict=True) if rows else [()] * len(PIECES.names), strict=True)))

    pieces = materialize(docs.select("doc_id", "text").mapInArrow(tidy(encode), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"), "pieces")
    counts = pieces.filter(F.col("length") < capacity).groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = materialize(counts, "piece counts")
    by_length = places(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = counts.selectExpr("length", "part", "sum(n) over (partition by length order by part) - n as before")
    ranked = pieces.filter(F.col("length") < capacity).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, at = by_length[int(n)], np.flatnonzero(length == n)
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = rows[k, 1] + rank[at] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    whole = pieces.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(WHOLE_FROM) + F.shiftleft("part", 33) + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(tidy(place), schema).union(whole)
