"""Mixing of sources to target weights, in DataFrame functions alone.

Each row has a hash-random key. Within a source, rows are taken in order of the key up to the source's budget of words; a
budget above the source's size repeats it for whole epochs first. The order is never sorted as a whole: word counts are
summed by ranges of the key, prefix sums over the ranges tell which range holds the cut, that range is divided again in
the same way, and only what stands in one of a million ranges is sorted. That gives each source's cut as one key, by
which every row is then decided alone, so the texts are read once for their sizes and, where they are wanted, once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.runtime import WORD, materialize

#: Bits of the key for each of the two divisions into ranges.
RANGE_BITS = 10
#: A source is taken at most so many times.
MOST_EPOCHS = 3
#: Fixed values of the contract: weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Source rows that may be broadcast.
BROADCAST_ROWS = 50_000
#: Parts in which rows that share the key of a cut are dealt.
TIED_PARTS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """sizes: source, source_size (words), a row per source. Adds target (double) and budget (whole words).

    The sources share `share` of all words by weight; none gets above MOST_EPOCHS times its size, and the excess goes to
    the others by weight until none is above. That is min(most, level * weight) with one level for all, found in rounds:
    a round's level is what the sources at their most leave, over the weight of the others. Sources are numbered by
    ranges of their order, so no task or driver holds all of them."""
    order = F.col("source").asc_nulls_last()
    s = sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    s = materialize(s, "mix source order")
    before = s.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))).cast("int") + 1)
    s = s.join(F.broadcast(before), "part").select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size").cast("double") * MOST_EPOCHS).alias("most"))
    s = materialize(s, "mix weights")
    all_, weights, n = s.agg(F.sum("source_size").cast("double"), F.sum("weight"), F.count("*")).first()
    level, full = (all_ * share / weights if n else 0.0), -1
    while n:
        at_most = F.col("most") <= F.lit(level) * F.col("weight")
        held, left, many = s.agg(F.sum(F.when(at_most, F.col("most")).otherwise(0.0)), F.sum(F.when(at_most, 0.0).otherwise(F.col("weight"))), F.count_if(at_most)).first()
        if many == full or many == n:
            break
        full, level = many, (all_ * share - held) / left
    s = s.withColumn("target", F.least("most", F.lit(level) * F.col("weight")))
    return s.select("source", "source_size", "target", F.least(F.round("target").cast("long"), F.col("most").cast("long")).alias("budget"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of sources only where its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _beside(a: DataFrame, b: DataFrame, many: int, *keys: str) -> DataFrame:
    b = b.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = [a[k].eqNullSafe(b[f"{k}_"]) for k in keys]
    return a.join(_small(b, many), on, "inner").drop(*(f"{k}_" for k in keys))


def _cut(df: DataFrame, by: str) -> DataFrame:
    """Per source: the group `by` that holds the cut, _left for the group, and how many rows it has."""
    sums = df.groupBy("_source", by).agg(F.sum("_size").alias("_in"), F.first("_left").alias("_left"), F.count("*").alias("_rows"))
    before = F.sum("_in").over(Window.partitionBy("_source").orderBy(by)) - F.col("_in")
    left = sums.withColumn("_left", F.col("_left") - before)
    return left.filter((F.col("_left") >= 0) & (F.col("_left") < F.col("_in"))).select("_source", by, "_left", "_rows")


def _hashed(docs: DataFrame) -> list[str]:
    """Columns that a hash can cover."""
    return [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def mix(docs: DataFrame, size: Column | None = None, share: float = 1.0, seed: int = 17) -> DataFrame:
    """docs (doc_id, source, and text unless size is given) with _size, _source_size, _target and _taken added: words
    of the document, of its source, its source's target, and words that the mix takes of it, repeats counted.

    Within a source the words taken are its target to the word; the one document that holds the cut is taken in part.
    No document is taken more than MOST_EPOCHS times. The key hangs on the seed and all columns of a row, so rows with
    one doc_id or none stand apart, and reruns agree: only rows that are equal throughout share a key, and which of
    these is cut is no difference. They are dealt in parts, so no task holds all copies of a row. A null source is a
    source of its own, and a null text has no words, so nothing is taken of it. An empty table gives no rows. All other
    columns stay; their names must not begin with an underscore. Without a text in docs, the result is made of what the
    first pass wrote."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *_hashed(docs)), 1)
    rows = docs.withColumns({"_size": size if size is not None else n_words(F.col("text")), "_source": F.col("source"), "_key": key})
    carried = "text" not in docs.columns
    light = materialize(rows if carried else rows.select("_source", "_size", "_key"), "mix sizes")
    sources = source_targets(light.groupBy("_source").agg(F.sum("_size").alias("source_size")).withColumnRenamed("_source", "source"), share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), epochs.alias("_epochs"), (F.col("budget") - epochs * F.col("source_size")).alias("_rest"))
    sources = materialize(sources, "mix sources")
    n = sources.count()

    first, second = F.shiftright("_key", 63 - RANGE_BITS), F.shiftright("_key", 63 - 2 * RANGE_BITS)
    sized = light.select("_source", "_size", "_key", first.alias("_r1"), second.alias("_r2"))
    cut1 = materialize(_cut(_beside(sized, sources.select("_source", F.col("_rest").alias("_left")), n, "_source"), "_r1"), "mix ranges").drop("_rows")
    cut2 = materialize(_cut(_beside(sized, cut1, n, "_source", "_r1"), "_r2"), "mix narrow ranges").drop("_rows")
    cuts = materialize(_cut(_beside(sized, cut2, n, "_source", "_r2"), "_key"), "mix cuts").withColumnRenamed("_key", "_cut")
    tied = not cuts.filter("_rows > 1").isEmpty()

    about = sources.join(_small(cuts.withColumnRenamed("_source", "_s"), n), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s", "_rest")
    placed = _beside(light if carried else rows, about, n, "_source")
    none = F.lit(0).cast("long")
    extra = F.when(F.col("_key") < F.col("_cut"), F.col("_size")).when(F.col("_key") == F.col("_cut"), F.least("_left", "_size")).otherwise(none)
    keep = [F.col(c) for c in docs.columns] + ["_size", "_source_size", "_target"]
    taken = lambda x: (F.col("_epochs") * F.col("_size") + x).alias("_taken")
    if not tied:
        return placed.select(*keep, taken(extra))
    shared = F.coalesce((F.col("_key") == F.col("_cut")) & (F.col("_rows") > 1), F.lit(False))
    dealt = materialize(placed.filter(shared).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(TIED_PARTS))), "mix tied rows")
    parts = dealt.groupBy("_source", "_part").agg(F.sum("_size").alias("_in"))
    parts = parts.select("_source", "_part", (F.sum("_in").over(Window.partitionBy("_source").orderBy("_part")) - F.col("_in")).alias("_before"))
    within = F.sum("_size").over(Window.partitionBy("_source", "_part").orderBy("_size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    rest = _beside(dealt, parts, n * TIED_PARTS, "_source", "_part").withColumn("_left", F.col("_left") - F.col("_before") - within)
    return placed.filter(~shared).select(*keep, taken(extra)).union(rest.select(*keep, taken(F.greatest(none, F.least("_size", "_left")))))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself, of mix()'s rows: each document as often as it is taken whole, and once with its first words if
    a part is left. Its added columns go; n_chars, where it is there, is counted again."""
    full = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(0).cast("int")
    part = (F.col("_taken") - full * F.col("_size")).cast("int")
    counts = F.concat(F.array_repeat(F.col("_size").cast("int"), full), F.filter(F.array(part), lambda x: x > 0))
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    leading = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    text = F.when(F.col("_n") < F.col("_size"), F.rtrim(F.concat_ws("", F.slice(pieces, F.lit(1), F.col("_n") + leading)))).otherwise(F.col("text"))
    out = mixed.withColumn("_n", F.explode(counts)).withColumn("text", text)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[c for c in mixed.columns if not c.startswith("_")])
