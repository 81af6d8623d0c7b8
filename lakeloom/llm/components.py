"""Connected components of a link table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.runtime import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).toDF("a", "b").filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a, b (longs; direction and repeats don't matter; self links and nulls are dropped).

    Returns (id, component_id) for each id with a link, its component's least id itself included. Each round is
    written to the shared scratch folder, so a lost executor costs one round at most; rounds grow with the logarithm
    of the longest path. Nothing but a row count and a checksum goes to the driver. No links give no rows."""
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    while True:
        new = materialize(_small_star(_large_star(edges)), "stars")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(edges)
        edges = new
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.union(edges.select(F.col("b"), F.col("b")).distinct()).toDF("id", "component_id")
