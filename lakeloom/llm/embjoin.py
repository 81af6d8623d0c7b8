"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at a cosine of c are at most sqrt(2 - 2c) = epsilon apart, and so are their projections. Vectors are put in
the order of the grid cells, of that width, that they fall in on a few leading principal axes. Intervals of this order
are joined recursively: two whose bounding boxes on these axes are further apart than epsilon are passed over, others are
halved down to blocks, whose cosines are computed as matrix products. The axes only serve to skip; any would be right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.components import connected_components
from lakeloom.llm.runtime import materialize

#: Leading principal axes, and the vectors, least by a hash, from which they are computed.
AXES, AXES_FROM = 4, 4096
#: Vectors of a block whose cosines are computed at once.
LEAF = 512
#: Bytes of the vectors in an interval, however many vectors there are: a task holds two intervals.
INTERVAL_BYTES = 16 << 20
#: Intervals whose boxes are broadcast at once, and rows of pairs that are.
BROADCAST_BOXES, BROADCAST_PAIRS = 1 << 19, 50_000


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Least distance of two boxes."""
    return float(np.linalg.norm(np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))))


def near_intervals(lo: np.ndarray, hi: np.ndarray, epsilon: float, lo2: np.ndarray | None = None, hi2: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of boxes not further apart than epsilon, of one sequence with itself (i <= j) or with a second one, by
    recursive halving of the sequences."""
    own = lo2 is None
    lo2, hi2 = (lo, hi) if own else (lo2, hi2)
    todo = [((0, len(lo)), (0, len(lo2)))] if len(lo) and len(lo2) else []
    while todo:
        (a, b), (c, d) = todo.pop()
        if own and a >= d or _apart(lo[a:b].min(0), hi[a:b].max(0), lo2[c:d].min(0), hi2[c:d].max(0)) > epsilon:
            continue
        if b - a == 1 and d - c == 1:
            yield a, c
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [((a, m), (c, d)), ((m, b), (c, d))]
        else:
            m = (c + d) // 2
            todo += [((a, b), (c, m)), ((a, b), (m, d))]


def _leaves(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(0, len(y), LEAF)
    return at, np.minimum.reduceat(y, at), np.maximum.reduceat(y, at)


def join_blocks(x: np.ndarray, y: np.ndarray, weight: np.ndarray, split: int, cosine: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the first `split` vectors and the others, or among all if split is their number. x: vectors,
    y: projections, weight: rows that a vector stands for. Returns (linked rows of each vector, the place of the first
    vector that it is joined with by these links)."""
    n, norm, own = len(x), np.sqrt((x * x).sum(axis=1)), split == len(x)
    linked, label = np.zeros(n, np.int64), np.arange(n)
    at_a, lo_a, hi_a = _leaves(y[:split])
    at_b, lo_b, hi_b = (at_a, None, None) if own else _leaves(y[split:])
    shift = 0 if own else split
    for i, j in near_intervals(lo_a, hi_a, epsilon, lo_b, hi_b):
        a = np.arange(at_a[i], min(at_a[i] + LEAF, split))
        b = shift + np.arange(at_b[j], min(at_b[j] + LEAF, n - shift))
        near = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine
        if own and i == j:
            near = np.triu(near, 1)
        r, c = np.nonzero(near)
        if not len(r):
            continue
        r, c = a[r], b[c]
        np.add.at(linked, r, weight[c])
        np.add.at(linked, c, weight[r])
        pairs = np.unique(np.stack([label[r], label[c]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if len(pairs):
            parent: dict[int, int] = {}

            def root(k: int) -> int:
                while (up := parent.get(k, k)) != k:
                    parent[k] = parent.get(up, up)
                    k = up
                return k

            for u, v in pairs.tolist():
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            to = np.arange(n)
            for k in list(parent):
                to[k] = root(k)
            label = to[label]
    return linked, label


def _axes(heads: DataFrame, n: int, d: int) -> np.ndarray:
    """Leading principal axes of about AXES_FROM vectors; a share of all passes a hash, so that the driver gets as many
    however many partitions there are."""
    bound = 1 << 40
    share = min(bound, -(-2 * bound * AXES_FROM // n))
    some = heads.withColumn("key", F.pmod(F.xxhash64("id"), F.lit(bound))).filter(F.col("key") < share)
    sample = np.array([r[0] for r in some.orderBy("key", "id").limit(AXES_FROM).select("embedding").collect()], np.float64).reshape(-1, d)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    around = sample.T @ sample - len(sample) * np.outer(sample.mean(0), sample.mean(0)) if len(sample) else np.eye(d)
    return np.ascontiguousarray(np.linalg.eigh(around)[1][:, ::-1][:, :AXES])


def interval_rows(n: int, d: int, tasks: int) -> int:
    """Vectors of an interval: as few intervals as give each task some pairs of them, since every vector is sent once for
    each interval that its own may meet, but none beyond INTERVAL_BYTES."""
    wanted = int(np.ceil(np.sqrt(8 * tasks)))
    return max(1, min(max(LEAF, -(-n // wanted)), INTERVAL_BYTES // (8 * d)))


def _pairs(boxes: DataFrame, names: list[str], epsilon: float) -> DataFrame:
    """(a, b, interval, side): a row for each side of each pair of intervals that may hold a link. Tasks take intervals
    against all boxes, which they get in parts of bounded size."""
    many = boxes.agg(F.max("interval")).first()[0] + 1
    chunks = [(k, k + BROADCAST_BOXES) for k in range(0, many, BROADCAST_BOXES)]
    sides = [f"{f}_{c}" for f in ("min", "max") for c in names]

    def against(chunk: tuple[int, int]) -> DataFrame:
        other = boxes.filter((F.col("interval") >= chunk[0]) & (F.col("interval") < chunk[1])).orderBy("interval").toPandas()
        shared = boxes.sparkSession.sparkContext.broadcast((other["interval"].to_numpy(), other[sides[: len(names)]].to_numpy(), other[sides[len(names) :]].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, lo2, hi2 = shared.value
            for batch in batches:
                own = batch.column("interval").to_numpy()
                lo, hi = (np.stack([batch.column(c).to_numpy() for c in x], axis=1) for x in (sides[: len(names)], sides[len(names) :]))
                order = np.argsort(own)
                found = [(own[order[i]], key[j]) for i, j in near_intervals(lo[order], hi[order], epsilon, lo2, hi2)]
                rows = [(a, b, x, s) for a, b in found if a <= b for s, x in enumerate((a, b)) if s == 0 or a != b]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "interval", "side"])

        return boxes.mapInArrow(run, "a long, b long, interval long, side long")

    out = against(chunks[0])
    for chunk in chunks[1:]:
        out = out.union(against(chunk))
    return out


def _of_dimension(heads: DataFrame, n: int, d: int, cosine: float) -> DataFrame:
    """heads: id, m, embedding of d components. Rows (id, linked, other): rows linked within one pair of intervals, and
    a vector that it is joined with there."""
    epsilon = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    axes = _axes(heads, n, d)
    names = [f"y{k}" for k in range(axes.shape[1])]
    cells = [f"c{k}" for k in range(axes.shape[1])]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, d)
            y = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ axes
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("m"), packed, *(pa.array(v) for v in y.T), *(pa.array(np.floor(v / epsilon).astype(np.int32)) for v in y.T)], names=["id", "m", "x", *names, *cells])

    projected = heads.mapInArrow(project, "id long, m long, x binary, " + ", ".join([f"{c} double" for c in names] + [f"{c} int" for c in cells]))
    rows = interval_rows(n, d, heads.sparkSession.sparkContext.defaultParallelism)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            nth = seen + np.arange(batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nth), part)), pa.array(nth), *(batch.column(c) for c in ["id", "m", "x", *names])], names=["part", "nth", "id", "m", "x", *names])

    ordered = materialize(projected, "projected").repartitionByRange(*cells, "id").sortWithinPartitions(*cells, "id").drop(*cells)
    ordered = materialize(ordered.mapInArrow(number, "part long, nth long, id long, m long, x binary, " + ", ".join(f"{c} double" for c in names)), "grid order")
    before = ordered.groupBy("part").agg(F.count("*").alias("held"))  # a row for each partition
    before = before.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    interval = F.floor((F.col("before") + F.col("nth")) / rows)
    ordered = ordered.join(F.broadcast(before), "part").select(interval.alias("interval"), "id", "m", "x", *names)
    boxes = materialize(ordered.groupBy("interval").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in names]), "boxes")
    sides = materialize(_pairs(boxes, names, epsilon), "interval pairs")
    sent = ordered.join(F.broadcast(sides) if sides.count() <= BROADCAST_PAIRS else sides, "interval")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", *names[:1]], kind="stable")
        x = np.frombuffer(b"".join(pdf["x"]), np.float64).reshape(-1, d)
        split = int((pdf["side"] == 0).sum())
        linked, label = join_blocks(x, pdf[names].to_numpy(), pdf["m"].to_numpy(), split, cosine, epsilon)
        ids, some = pdf["id"].to_numpy(), linked > 0
        return pd.DataFrame({"id": ids[some], "linked": linked[some], "other": ids[label[some]]})

    return sent.groupBy("a", "b").applyInPandas(compare, "id long, linked long, other long")


def link_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors are linked if they have as many components and their cosine, in double precision, is at least `cosine`;
    component_id is the least vec_id that links reach. A vector that is null, empty or zero, or has null or non-finite
    components, links with nothing, and so does a row with a null vec_id, which is kept. Equal vectors are one class
    from the start and cost one comparison. Rows with one vec_id and different vectors are one as to components, and
    each has its own vector's n_links. An empty table gives no rows."""
    v = vectors.select("vec_id", "embedding")
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fit", F.coalesce(fit & F.col("vec_id").isNotNull(), F.lit(False)))
    hashes = [F.when(F.col("fit"), F.xxhash64(F.lit(s), "embedding")).alias(f"h{s}") for s in (1, 2)]
    named = v.filter("fit").select("vec_id", "embedding", *hashes)
    classes = named.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.any_value("embedding").alias("embedding"))
    heads = materialize(classes.withColumns({"d": F.size("embedding"), "node": F.monotonically_increasing_id()}), "vector classes")
    found = [_of_dimension(heads.filter(F.col("d") == r["d"]).select(F.col("node").alias("id"), "m", "embedding"), r["count"], r["d"], cosine) for r in heads.groupBy("d").count().orderBy("d").collect() if r["count"] > 1]
    about = heads.select("h1", "h2", "node", "id", "m")
    ids = named.select("vec_id", "h1", "h2").distinct().groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    if found:
        links = found[0]
        for f in found[1:]:
            links = links.union(f)
        links = materialize(links, "vector links")
        edges = links.select(F.col("id").alias("a"), F.col("other").alias("b"))
        linked = links.groupBy(F.col("id").alias("node")).agg(F.sum("linked").alias("linked"))
        about = about.join(linked, "node", "left")
    else:
        edges, about = None, about.withColumn("linked", F.lit(0).cast("long"))
    if not ids.isEmpty():  # rows with one vec_id join their vectors
        several = named.select("vec_id", "h1", "h2").join(ids, "vec_id", "left_semi").join(heads.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node").distinct()
        joined = several.join(several.groupBy("vec_id").agg(F.min("node").alias("b")), "vec_id").select(F.col("node").alias("a"), "b")
        edges = joined if edges is None else edges.union(joined)
    if edges is None:
        about = about.withColumn("component_id", F.col("id"))
    else:
        parts = connected_components(edges).withColumnsRenamed({"id": "node", "component_id": "label"})
        parts = materialize(parts.join(heads.select("node", "id"), "node"), "vector parts")
        least = parts.groupBy("label").agg(F.min("id").alias("component_id"))
        about = about.join(parts.select("node", "label").join(least, "label").select("node", "component_id"), "node", "left")
    out = v.select("vec_id", *hashes).join(about, ["h1", "h2"], "left")
    part = F.coalesce("component_id", "id", "vec_id")
    out = out.select("vec_id", F.coalesce(F.coalesce("linked", F.lit(0)) + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
