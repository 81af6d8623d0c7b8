"""Readers and writers outside the data model's tables: source addresses, folders of files, lines of JSON, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """kind (s3, gcs, git-lfs or file), root (bucket, repository, or / for files) and path (prefix, ref or path)."""

    kind: str
    root: str
    path: str


def parse_source(uri: str) -> Source:
    """The source of an address; an absolute path is a file. ValueError for any other."""
    for scheme in ("s3", "gcs"):
        if uri.startswith(f"{scheme}://"):
            root, _, path = uri.removeprefix(f"{scheme}://").partition("/")
            return Source(scheme, root, path)
    if uri.startswith("git-lfs://"):
        root, _, ref = uri.removeprefix("git-lfs://").partition("#")
        return Source("git-lfs", root, ref or "main")
    if uri.startswith(("/", "file://")):
        return Source("file", "/", uri.removeprefix("file://"))
    raise ValueError(f"unknown source address: {uri}")


def list_files(spark: SparkSession, folder: str, limit: int | None = None, folders: bool = False) -> DataFrame:
    """path, name, size of the files right in a folder, in name order, `limit` of them at most; with folders, of those that hold
    any file too, each with the size of all files below it. Contents aren't read; Spark passes over files without a byte."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", folders).load(folder)
    parts = F.split("path", "/")
    if folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        root = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()
        depth = root.rstrip("/").count("/") + 1
        out = found.groupBy(F.array_join(F.slice(parts, 1, depth + 1), "/").alias("path"), F.get(parts, F.lit(depth)).alias("name")).agg(F.sum("length").alias("size"))
    else:
        out = found.select("path", F.element_at(parts, -1).alias("name"), F.col("length").alias("size"))
    out = out.orderBy("name")
    return out if limit is None else out.limit(limit)


def fetch(spark: SparkSession, path: str) -> DataFrame:
    """path, content of one file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir; in local mode, where that is unset, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[")
        root = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines and those that don't parse are dropped. A folder that isn't there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def save_registry(rows: DataFrame, path: str) -> None:
    """Write a small table of settings as JSON lines, in place of what is there."""
    rows.write.mode("overwrite").json(path)


def load_registry(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows that save_registry() wrote; a folder that isn't there has none."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
