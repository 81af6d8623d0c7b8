"""Content addressing, trees of files, versions and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose hash isn't there yet, each hash once."""
    return new.dropDuplicates(["hash"]).join(existing.select("hash"), "hash", "left_anti")


def under(path: Column, root: str) -> Column:
    """Whether a path is root or below it, by whole segments."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """A snapshot in which old's subtree stands at new, over what was there."""
    moved = files.filter(under(F.col("path"), old)).withColumn("path", F.concat(F.lit(new.rstrip("/")), F.substr("path", F.lit(len(old.rstrip("/")) + 1))))
    kept = files.filter(~under(F.col("path"), old)).join(moved.select("path"), "path", "left_anti")
    return kept.unionByName(moved)


def fork(files: DataFrame, old: str, new: str) -> DataFrame:
    """files with a copy of old's subtree at new; contents are shared by hash."""
    copied = files.filter(under(F.col("path"), old)).withColumn("path", F.concat(F.lit(new.rstrip("/")), F.substr("path", F.lit(len(old.rstrip("/")) + 1))))
    return files.join(copied.select("path"), "path", "left_anti").unionByName(copied)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """op (add, del, mod), path of two listings (path, hash)."""
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    op = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "del").otherwise("mod")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select(op.alias("op"), "path")


def normal_path(path: Column) -> Column:
    """Slashes for backslashes, one for several, none at the end; null for a relative path or one with . or .. in it."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))
    return F.when(p.startswith("/") & ~p.rlike(r"(^|/)\.{1,2}(/|$)"), p)


def delete_chunks(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without those whose hash is in gone."""
    return chunks.join(gone.select("hash"), "hash", "left_anti")


def commit(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """commits with one more on each head. heads: author, head, and the new commit's hash and ts."""
    return commits.unionByName(heads.select("hash", F.col("head").alias("parent"), "author", "ts"))


def branch_results(branches: DataFrame, operations: DataFrame, current: str) -> DataFrame:
    """operations (op, name) with result: ok, exists (create of a branch that is there), missing (delete of one that is
    not) or current (delete of the branch that HEAD points at)."""
    j = operations.join(branches.select("name", F.lit(True).alias("there")), "name", "left")
    there = F.col("there").isNotNull()
    create = F.when(there, "exists").otherwise("ok")
    delete = F.when(F.col("name") == current, "current").when(there, "ok").otherwise("missing")
    return j.select("op", "name", F.when(F.col("op") == "create", create).otherwise(delete).alias("result"))


def empty_store(spark: SparkSession) -> DataFrame:
    """The one row of a new store: its root, the root's content id, and the branch that HEAD points at."""
    return spark.range(1).select(F.lit("/").alias("path"), F.lit("dir").alias("kind"), F.sha2(F.lit(""), 256).alias("hash"), F.lit("main").alias("branch"))


def transfer(objects: DataFrame, files: DataFrame, by_hash: bool = False) -> DataFrame:
    """objects (path, size, readable, and hash with by_hash) with outcome and bytes of a migration: skipped where the path (or
    the content) is there already, failed where it can't be read, else transferred."""
    key = "hash" if by_hash else "path"
    there = files.select(key).distinct().withColumn("there", F.lit(True))
    j = objects.join(there, key, "left")
    outcome = F.when(F.col("there").isNotNull(), "skipped").when(~F.col("readable"), "failed").otherwise("transferred")
    return j.withColumn("outcome", outcome).select(*objects.columns, "outcome", F.when(F.col("outcome") == "transferred", F.col("size")).otherwise(0).cast("long").alias("bytes"))


def transfer_stats(results: DataFrame) -> DataFrame:
    """Counts by outcome, bytes, and the share that didn't fail: 1 if there was nothing to do."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    total, failed = F.count("*"), n("failed")
    rate = F.when(total == 0, 1.0).otherwise((total - failed) / total)
    return results.agg(total.alias("total"), n("transferred").alias("transferred"), n("skipped").alias("skipped"), failed.alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(rate, 6).alias("success_rate"))
