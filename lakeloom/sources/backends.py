"""Backends that chunks can be kept in, all with the same methods, and a sample volume."""

from __future__ import annotations

import io
import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import store as V
from lakeloom.sources.connectors import exists


class ChunkBackend(Protocol):
    """chunks: hash, data. A put keeps what is there; a delete of what isn't there does nothing."""

    def put(self, chunks: DataFrame) -> None: ...
    def get(self, hashes: list[str]) -> DataFrame: ...
    def delete(self, hashes: DataFrame) -> None: ...
    def all(self) -> DataFrame: ...


class TableBackend:
    """Chunks in one table of the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.table = spark, spark.createDataFrame([], "hash string, data binary")

    def put(self, chunks: DataFrame) -> None:
        new = chunks.select("hash", "data").dropDuplicates(["hash"]).join(self.table.select("hash"), "hash", "left_anti")
        self.table = V.written(self.table.unionByName(new), "chunk-table")

    def get(self, hashes: list[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(h,) for h in hashes], "hash string")
        j = wanted.join(self.table, "hash", "left")
        return j.select("hash", F.col("data").isNotNull().alias("there"), F.octet_length("data").alias("size"), "data")

    def delete(self, hashes: DataFrame) -> None:
        self.table = V.written(self.table.join(hashes.select("hash"), "hash", "left_anti"), "chunk-table")

    def all(self) -> DataFrame:
        return self.table


class FolderBackend:
    """Chunks in a folder of shards. A delete writes anew the shards that it touches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, chunks: DataFrame) -> None:
        V.write_chunks(chunks.select("hash", "data").join(self.all().select("hash"), "hash", "left_anti"), self.folder)

    def get(self, hashes: list[str]) -> DataFrame:
        if exists(self.spark, self.folder):
            return V.get_chunks(self.spark, self.folder, hashes)
        return TableBackend(self.spark).get(hashes)

    def delete(self, hashes: DataFrame) -> None:
        shards = hashes.select(F.substring("hash", 1, 2).alias("shard")).distinct()
        kept = V.written(self.all_shards().join(shards, "shard", "left_semi").join(hashes.select("hash"), "hash", "left_anti"), "chunk-shards")
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for (s,) in shards.collect():  # 256 at most
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/shard={s}")
            p.getFileSystem(conf).delete(p, True)
        V.write_chunks(kept.select("hash", "data"), self.folder)

    def all_shards(self) -> DataFrame:
        found = exists(self.spark, self.folder)
        return V.read_chunks(self.spark, self.folder) if found else self.spark.createDataFrame([], "hash string, data binary, shard string")

    def all(self) -> DataFrame:
        return self.all_shards().select("hash", "data")


def sample_volume() -> list[tuple[str, bytes]]:
    """Files (path, content) to try a new store with: a text, a table, labels, and a model of two tensors."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = io.BytesIO()
    pq.write_table(pa.table({"sepal_length": pa.array([], pa.float64()), "petal_length": pa.array([], pa.float64())}), table)
    labels = "\n".join(json.dumps({"id": k, "label": ("setosa", "versicolor", "virginica")[k % 3], "sepal_length": 5 + k / 10, "petal_length": 1 + k / 5}) for k in range(10))
    head = json.dumps({"weight": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "bias": {"dtype": "F32", "shape": [2], "data_offsets": [16, 24]}}).encode()
    return [("/README.md", b"A volume to try things with.\n"), ("/datasets/iris.parquet", table.getvalue()), ("/datasets/labels.jsonl", labels.encode()), ("/models/tiny.safetensors", len(head).to_bytes(8, "little") + head + bytes(24))]
