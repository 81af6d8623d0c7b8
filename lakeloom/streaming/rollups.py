"""Roll-ups and upserts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of an upserted table, by a hash of the key: a batch writes only those that it touches.
PARTS = 64


def stream_rollup(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Edges by tumbling window and type of a streaming (or static) table of events; what comes later than `late` is dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_millis("w.start").alias("bucket"), "event_type", "n")


def _state(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The batch that last wrote each part, as the newest batch (before a given one) left it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(hadoop):
        return {}
    epochs = [int(f.getPath().getName()) for f in fs.listStatus(hadoop) if f.getPath().getName().isdigit()]
    epochs = [e for e in epochs if before is None or e < before]
    rows = spark.read.schema("part int, epoch long").json(f"{path}/state/{max(epochs)}").collect() if epochs else []
    return {r["part"]: r["epoch"] for r in rows}


def read_upserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that upsert_into() keeps."""
    found = [f"{path}/rows/epoch={e}/part={p}" for p, e in sorted(_state(spark, path).items())]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def upsert_into(path: str, key: str, order: str | None = None):
    """A foreachBatch function that keeps one row of each key in a Parquet table: that with the greatest `order`, or else any of
    the newest batch. Rows stand in parts by a hash of the key; a batch reads and writes the parts of its own keys, and what
    they replace goes once the batch after it is done. A batch that is run again gives the same table."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        parted = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).persist()
        state = _state(spark, path, epoch)
        touched = [r[0] for r in parted.select("part").distinct().collect()]
        old = [f"{path}/rows/epoch={state[p]}/part={p}" for p in touched if p in state]
        rows = parted
        if old:
            before = spark.read.schema(batch.schema).parquet(*old).withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
            rows = before.unionByName(parted) if order else before.join(parted.select(key), key, "left_anti").unionByName(parted.dropDuplicates([key]))
        if order:
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*columns, "part"), order).alias("r")).select("r.*")
        elif not old:
            rows = rows.dropDuplicates([key])
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/epoch={epoch}")
        parted.unpersist()
        now = state | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(now.items()) or [], "part int, epoch long").coalesce(1).write.mode("overwrite").json(f"{path}/state/{epoch}")
        _forget(spark, path, keep={*now.values(), *state.values()}, upto=epoch)

    return write


def _forget(spark: SparkSession, path: str, keep: set[int], upto: int) -> None:
    """Remove batches that neither the newest state nor the one before it names."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for epoch in range(max(0, upto - PARTS), upto):
        if epoch not in keep:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/epoch={epoch}")
            p.getFileSystem(conf).delete(p, True)
