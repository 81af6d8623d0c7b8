"""Text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Published BM25 parameters.
K1, B = 1.2, 0.75
#: Smallest normaliser of scores: the machine epsilon of single floats.
EPSILON = 1.1920929e-7


def tokens(text: Column) -> Column:
    """Runs of letters and digits, case kept."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / norm)))


def vector_topk(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k vectors nearest to the one of query (column q, one row), of as many components; ties by key."""
    scored = vectors.join(F.broadcast(query.limit(1)), F.size("embedding") == F.size("q")).withColumn("score", F.round(cosine(F.col("embedding"), F.col("q")), 6))
    return scored.drop("q").orderBy(F.desc("score"), key).limit(k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, weight: float, k: int) -> DataFrame:
    """Full outer merge of two scored hit lists (doc_id, score): each score over its list's greatest one, weighted, summed."""
    weight = min(1.0, max(0.0, weight))

    def normal(df: DataFrame, name: str) -> DataFrame:
        top = F.greatest(F.max("score").over(Window.partitionBy(F.lit(1))), F.lit(EPSILON))
        return df.select("doc_id", (F.greatest(F.lit(0.0), F.col("score") / top)).alias(name))

    both = normal(text_hits, "t").join(normal(vector_hits, "v"), "doc_id", "full_outer")
    score = (1 - weight) * F.coalesce("t", F.lit(0.0)) + weight * F.coalesce("v", F.lit(0.0))
    return both.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def mark_stale(vectors: DataFrame, current: str) -> DataFrame:
    return vectors.withColumn("stale", F.col("stale") | (F.col("model_version") != current))
