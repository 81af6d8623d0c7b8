"""Lineage graph: neighbours, bounded breadth-first search over edges, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.store import written

#: Kinds of edges.
KINDS = ("read", "write", "derive", "copy", "transform")
#: Ids, and blocks of ids, that are counted together.
BLOCK = 4096


def parents(edges: DataFrame, h: str) -> DataFrame:
    return edges.filter(F.col("sink_hash") == h)


def children(edges: DataFrame, h: str) -> DataFrame:
    return edges.filter(F.col("source_hash") == h)


def reach(edges: DataFrame, start: str, depth: int, up: bool = True) -> DataFrame:
    """Edges whose near end is less than depth hops from the start, each id once: a level joins the frontier of nodes with
    the edges and leaves out nodes seen before, so circles end it. Each level is written once; the next one reads it."""
    near, far = ("sink_hash", "source_hash") if up else ("source_hash", "sink_hash")
    seen = edges.sparkSession.createDataFrame([(start,)], "node string")
    frontier, found = seen, None
    for _ in range(depth):
        step = written(edges.join(frontier, F.col(near) == F.col("node"), "left_semi"), "lineage")
        found = step if found is None else found.unionByName(step)
        frontier = written(step.select(F.col(far).alias("node")).distinct().join(seen, "node", "left_anti"), "lineage-frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return edges.limit(0) if found is None else found.dropDuplicates(["id"])


def rollup(edges: DataFrame, width_ms: int) -> DataFrame:
    """Per tumbling bucket: edges of each kind that occurs (a map), exact distinct sources and sinks; one aggregation."""
    b = edges.withColumn("bucket", F.col("ts") - F.pmod("ts", F.lit(width_ms)))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    g = b.groupBy("bucket").agg(*counts, F.count_distinct("source_hash").alias("sources"), F.count_distinct("sink_hash").alias("sinks"))
    kinds = F.map_filter(F.create_map(*[x for k in sorted(KINDS) for x in (F.lit(k), F.col(k))]), lambda _, n: n > 0)
    return g.select("bucket", kinds.alias("kinds"), "sources", "sinks")


def rollup_total(rolled: DataFrame) -> DataFrame:
    return rolled.select("bucket", F.aggregate(F.map_values("kinds"), F.lit(0).cast("long"), lambda a, n: a + n).alias("total"))


def sampled(edges: DataFrame, rate: float) -> DataFrame:
    """Deterministic sample: of each thousand in order of id, the numbers below the rate; counting starts at 1. Ranks are counted
    by blocks of ids and blocks of these, so no task numbers all edges."""
    threshold = round(min(1.0, max(0.0, rate)) * 1000)
    part = F.floor(F.col("id") / BLOCK)
    counts = edges.groupBy(part.alias("part")).agg(F.count("*").alias("m")).withColumn("block", F.floor(F.col("part") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("m").alias("b"))
    blocks = blocks.select("block", (F.sum("b").over(Window.orderBy("block")) - F.col("b")).alias("start"))
    before = (F.sum("m").over(Window.partitionBy("block").orderBy("part")) - F.col("m")).alias("inside")
    counts = counts.select("part", "block", before).join(blocks, "block").select("part", (F.col("start") + F.col("inside")).alias("before"))
    ranked = edges.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    return ranked.join(counts, "part").filter((F.col("before") + F.col("nth")) % 1000 < threshold).drop("part", "nth", "before")


def parse_kind(text: Column) -> Column:
    """A kind of edge by its name; null for any other text."""
    return F.when(text.isin(*KINDS), text)


def valid(edges: DataFrame) -> DataFrame:
    """Edges that may be recorded: known ends that differ; the kind defaults to derive."""
    known = (F.col("source_hash") != "u0") & (F.col("sink_hash") != "u0")
    return edges.filter(known & (F.col("source_hash") != F.col("sink_hash"))).withColumn("kind", F.coalesce("kind", F.lit("derive")))


def provenance(edges: DataFrame, h: str) -> DataFrame:
    """subject and its direct parents (kind, source, agent, ts), in order of time."""
    parent = F.struct("ts", "id", "kind", F.col("source_hash").alias("source"), "agent")
    return parents(edges, h).groupBy(F.col("sink_hash").alias("subject")).agg(F.array_sort(F.collect_list(parent)).alias("direct_parents"))
