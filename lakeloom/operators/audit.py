"""Hash-chained audit logs. An entry's hash is that of its sorted fields, the hash before it among them."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "genesis"
ENTRY = "log long, seq long, ts long, event_type string, subject string, actor string, detail map<string,string>, hash string, prev_hash string"
#: Entries of a log that a task numbers or compares with their predecessors at once.
BLOCK = 1 << 16


def canonical(prev: Column) -> Column:
    """The JSON that is hashed: fields in alphabetical order, detail by key, the hash itself left out."""
    return F.concat(*_around(prev))


def _around(prev: Column) -> list[Column]:
    detail = F.map_from_entries(F.array_sort(F.map_entries("detail")))
    first = F.to_json(F.struct("actor", detail.alias("detail"), "event_type"))
    rest = F.to_json(F.struct("seq", "subject", "ts"))
    return [F.substr(first, F.lit(1), F.length(first) - 1), F.lit(',"prev_hash":"'), prev, F.lit('",'), F.substr(rest, F.lit(2))]


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """The whole logs with new entries (log, ord, ts, event_type, subject, actor, detail) at their ends, in order of ord.

    Each hash needs the one before it, so the new entries of one log are chained by one task; JSON is made beside that,
    and what was in the logs is only looked at for its last entries."""
    tails = log.groupBy("log").agg(F.max("seq").alias("last"), F.max_by("hash", "seq").alias("last_hash"))
    nth = F.row_number().over(Window.partitionBy("log").orderBy("ord"))
    e = new.join(tails, "log", "left").withColumn("seq", F.coalesce(F.col("last") + 1, F.lit(0).cast("long")) + nth - 1)
    around = _around(F.lit(""))
    e = e.withColumns({"head": F.concat(*around[:2]), "tail": F.concat(*around[3:]), "prev_hash": F.coalesce("last_hash", F.lit(GENESIS))})
    columns = ["log", "seq", "ts", "event_type", "subject", "actor", "detail"]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        prev, hashes, before = pdf["prev_hash"].iloc[0], [], []
        for head, tail in zip(pdf["head"], pdf["tail"], strict=True):
            before.append(prev)
            prev = hashlib.sha256(f"{head}{prev}{tail}".encode()).hexdigest()
            hashes.append(prev)
        return pd.DataFrame({"log": pdf["log"], "seq": pdf["seq"], "hash": hashes, "prev_hash": before})

    chained = e.select("log", "seq", "prev_hash", "head", "tail").groupBy("log").applyInPandas(chain, "log long, seq long, hash string, prev_hash string")
    added = e.select(*columns).join(chained, ["log", "seq"])
    return log.unionByName(added)


def _before(log: DataFrame) -> DataFrame:
    """log with the hash of each entry's predecessor: the one of the next lower seq that is there."""
    block = F.floor(F.col("seq") / BLOCK)
    last = log.groupBy("log", block.alias("block")).agg(F.max_by("hash", "seq").alias("hash"))
    last = last.select("log", "block", F.lag("hash").over(Window.partitionBy("log").orderBy("block")).alias("border"))
    near = log.withColumn("block", block).withColumn("before", F.lag("hash").over(Window.partitionBy("log", "block").orderBy("seq")))
    return near.join(last, ["log", "block"]).withColumn("before", F.coalesce("before", "border", F.lit(GENESIS))).drop("block", "border")


def verify_entries(log: DataFrame) -> DataFrame:
    """log, seq, ok: whether the entry names the hash before it and its own hash is right."""
    ok = (F.col("prev_hash") == F.col("before")) & (F.col("hash") == F.sha2(canonical(F.col("prev_hash")), 256))
    return _before(log).select("log", "seq", ok.alias("ok"))


def verify_chain(log: DataFrame) -> DataFrame:
    """log, entries, valid: whether every link of a log holds."""
    return verify_entries(log).groupBy("log").agg(F.count("*").alias("entries"), F.bool_and("ok").alias("valid"))


def recover(log: DataFrame) -> DataFrame:
    """log, next_seq, prev_hash: where each log goes on."""
    return log.groupBy("log").agg((F.max("seq") + 1).alias("next_seq"), F.max_by("hash", "seq").alias("prev_hash"))
