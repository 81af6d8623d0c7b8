"""Near-duplicate documents by min-max hashing: of each permutation both the least and the greatest value are kept, so
half the permutations give the whole signature.

Documents with equal shingle sets are one class from the start. Classes that share a band of signature values share a
bucket. A bucket is never turned into all its pairs: its members are compared with one centre. Those linked with it are
joined by that, and for the others an exact bound on what they have in common besides tells whom they can be linked
with. So no link that would join two components is lost, and copies cost one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.components import connected_components
from lakeloom.llm.runtime import discard, materialize, record, small_batches, texts, tidy, worker_state

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
#: Places in the map of documents whose sets are wanted: a broadcast of this fixed size in bits.
MAP_PLACES = 1 << 22
#: Members of a centre that are compared in one block, and tokens of their residuals at once.
BLOCK_ROWS, BLOCK_TOKENS = 512, 2048
#: Shingles that are hashed together.
BATCH_SHINGLES = 1 << 18
#: Word hashes kept by a worker.
KEPT_WORDS = 200_000
_M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of k words; with fewer words the whole sequence is one; none if there
    is no word. A-Z count as a-z; words are runs of anything but ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(worker_state("word hashes", _Words).__getitem__, words)), np.uint64)
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mixed(h * _M + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band hashes (sets x bands) of sets that are not empty. Signature value 2j is the least and 2j + 1 the greatest
    of a set under permutation j."""
    rng = np.random.default_rng(seed)
    perms = -(-bands * rows // 2)
    multiply = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, perms, dtype=np.uint64)
    out = np.empty((len(sets), bands), np.uint64)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (held == 0 or held + len(sets[last]) <= BATCH_SHINGLES):
            held += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]])]).astype(np.intp)
        values = np.empty((last - first, 2 * perms), np.uint64)
        for j in range(perms):
            v = (flat ^ add[j]) * multiply[j]
            values[:, 2 * j], values[:, 2 * j + 1] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
        h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (last - first, 1))
        grid = values[:, : bands * rows].reshape(last - first, bands, rows)
        for i in range(rows):
            h = _mixed(h * _M + grid[:, :, i])
        out[first:last] = h
        first = last
    return out


def _sign(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k) for t in texts(batch)]
            full = [i for i, s in enumerate(sets) if len(s)]
            made = iter(signatures([sets[i] for i in full], bands, rows).view(np.int64).tolist()) if full else iter(())
            digests = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
            d1, d2 = (np.array([d[i] for d in digests], np.uint64).view(np.int64) for i in (0, 1))
            yield record(SIGNED, doc_id=batch.column("doc_id"), n_shingles=[len(s) for s in sets], d1=d1, d2=d2, bands=[next(made) if len(s) else None for s in sets])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles) of the wanted documents; a few others may be among them."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_PLACES)).cast("int")
    docs = docs.select("doc_id", "text")
    if wanted.count() > MAP_PLACES // 4:  # the map would pass most documents: join them instead
        docs = docs.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        marked = None
    else:
        places = wanted.select(F.pmod(F.xxhash64("id"), F.lit(MAP_PLACES)).cast("int").alias("p")).distinct().toPandas()["p"].to_numpy()
        bits = np.zeros(MAP_PLACES, bool)
        bits[places] = True
        marked = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = None if marked is None else np.unpackbits(marked)
        for batch in batches:
            if on is not None:
                batch = batch.filter(pa.array(on[batch.column("place").to_numpy()].astype(bool)))
            sets = [shingle_set(t, k) for t in texts(batch)]
            yield record(SETS, id=batch.column("doc_id"), n=[len(s) for s in sets], shingles=[s.tobytes() for s in sets])

    return docs.filter("doc_id is not null").withColumn("place", place).mapInArrow(tidy(run), "id long, n long, shingles binary").filter("n > 0")


def _against_centre(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of each pair (c, id) of a centre and a member: n and nc (set sizes), linked, missing and extra (the centre's
    shingles that the member lacks, and those that it has besides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, missing, extra = [], [], []
            for x, y in zip(batch.column("sx"), batch.column("sc"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                order = np.argsort(both, kind="stable")
                both = both[order]
                same = np.zeros(len(both), bool)
                same[1:] = both[1:] == both[:-1]
                shared = int(same.sum())
                same[:-1] |= same[1:]
                alone, of_x = both[~same], order[~same] < len(x)
                linked.append(100 * shared >= percent * (len(both) - shared))
                missing.append(alone[~of_x].view(np.int64))
                extra.append(alone[of_x].view(np.int64))
            tokens = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("c", "id", "n", "nc")), pa.array(linked, pa.bool_()), pa.array(missing, tokens), pa.array(extra, tokens)], names=["c", "id", "n", "nc", "linked", "missing", "extra"])

    x = sets.select("id", "n", F.col("shingles").alias("sx"))
    c = sets.select(F.col("id").alias("c"), F.col("n").alias("nc"), F.col("shingles").alias("sc"))
    return pairs.join(x, "id").join(c, "c").mapInArrow(tidy(run), "c long, id long, n long, nc long, linked boolean, missing array<long>, extra array<long>")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of tokens that each of x has in common with each of y."""
    (fx, rx), (fy, ry) = ((np.concatenate(v), np.repeat(np.arange(len(v)), [len(t) for t in v])) for v in (x, y))
    both = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), np.float32)
    for k in range(0, len(both), BLOCK_TOKENS):
        part = both[k : k + BLOCK_TOKENS]
        grids = []
        for flat, rows, n in ((fx, rx, len(x)), (fy, ry, len(y))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            grid = np.zeros((n, len(part)), np.float32)
            grid[rows[hit], at[hit]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs (a, b) that join what was apart before."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while (to := up.get(k, k)) != k:
            up[k] = up.get(to, to)
            k = to
        return k

    out = []
    for a, b in pairs.tolist():
        u, v = root(a), root(b)
        if u != v:
            up[u] = v
            out.append((a, b))
    return out


def _beside_centre(found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one centre, one of which at least isn't linked with the centre; of links that
    form a circle one may be missing.

    Let x be such a member and y another one. Both are told by what they lack of the centre and have besides, and
    these residuals, which are short for near copies, give their similarity exactly. With none in common, y is no
    nearer to x than the centre is; the least overlap follows from the sizes, and a member whose whole residual is
    shorter can't be linked. The others are compared in blocks of bounded size, as products of token matrices."""
    t = percent
    less, more = F.size("missing"), F.size("extra")
    need = F.floor((100 * less + t * more) / (100 + t)) + 1
    own = F.when(F.col("linked"), 0).otherwise(F.ceil((t * (F.col("n") + F.col("nc")) - (100 + t) * (F.col("n") - more)) / (100 + t)))
    able = found.filter(less + more >= F.greatest(need, own))
    sizes = able.groupBy("c").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("ny"), F.ceil(F.count_if(~F.col("linked")) / BLOCK_ROWS).cast("int").alias("nx"), F.count("*").alias("m")).filter("m > 1 and nx > 0").drop("m")
    rest = able.join(sizes, "c")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["c", "id", "n", "nc", "missing", "extra"]
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rest.filter(~F.col("linked")).select(*columns, F.lit(0).alias("side"), place("nx").alias("xb"), all_blocks("ny").alias("yb"))
    y = rest.select(*columns, F.lit(1).alias("side"), all_blocks("nx").alias("xb"), place("ny").alias("yb"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, ids, n, nc = (table.column(c).to_numpy() for c in ("side", "id", "n", "nc"))

        def lists(column: str) -> list[np.ndarray]:
            c = table.column(column).chunk(0)
            flat, at = c.flatten().to_numpy(), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])
            return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

        missing, extra = lists("missing"), lists("extra")
        lack = np.array([len(v) for v in missing])
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs = []
        if len(i) and len(j):
            tokens = [np.concatenate([~a, b]) for a, b in zip(missing, extra, strict=True)]
            shared = nc[0] - lack[i][:, None] - lack[j][None, :] + _overlaps([tokens[k] for k in i], [tokens[k] for k in j])
            near = 100 * shared >= t * (n[i][:, None] + n[j][None, :] - shared)
            r, c = np.nonzero(near & (ids[i][:, None] != ids[j][None, :]))
            pairs = _forest(np.stack([ids[i][r], ids[j][c]], axis=1))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    # dealt by all three: the join before has dealt rows by centre, and grouping alone would keep one's blocks in one task
    return x.union(y).repartition("c", "xb", "yb").groupBy("c", "xb", "yb").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of `words`-word shingles have 100 * intersection >= percent * union, confirmed
    on whole sets; component_id is the least doc_id that links reach. A pair at the threshold s shares no bucket with
    probability (1 - s**rows) ** bands, 7e-6 for the defaults. A null or empty text or one of white space has no shingles
    and no links. Rows with one doc_id are one document as to links. A row with a null doc_id can't be named by others:
    it has no component and is kept. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    sig = materialize(_sign(docs, words, bands, rows), "signatures")
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "classes")
    heads = named.join(classes, ["d1", "d2"]).filter("doc_id = id").select("id", "n_shingles", "bands")
    entries = heads.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    members = materialize(entries.join(shared.select("key"), "key"), "buckets")
    if members.isEmpty():
        parts = None
    else:
        sets = materialize(_sets(docs, members.select("id").distinct(), words), "sets")
        parts = _join(members, sets, percent)
        discard(sets)
    out = sig.join(classes, ["d1", "d2"], "left") if parts is None else sig.join(classes.join(parts, "id", "left"), ["d1", "d2"], "left")
    part = F.col("id") if parts is None else F.coalesce("component_id", "id")
    part = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), part).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", part.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _join(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of the classes in buckets: members has key and id. A bucket's centre is the member that stands with
    most others in its buckets."""
    many = members.groupBy("key").agg(F.count("*").alias("m"))
    degree = members.join(many, "key").groupBy("id").agg(F.sum("m").alias("degree"))
    rank = F.shiftleft("degree", 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    ranked = materialize(members.join(degree.select("id", rank.alias("rank")), "id").select("key", "id", "rank"), "ranked buckets")
    centres = ranked.groupBy("key").agg(F.max_by("id", "rank").alias("c"))
    pairs = ranked.join(centres, "key").filter("id <> c").select("c", "id").distinct()
    found = materialize(_against_centre(pairs, sets, percent), "against centres")
    direct = found.filter("linked").select(F.col("c").alias("a"), F.col("id").alias("b"))
    return connected_components(direct.union(_beside_centre(found, percent)))
