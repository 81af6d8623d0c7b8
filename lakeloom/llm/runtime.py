"""What the operators of this subpackage share: the scratch folder, lineage cuts, and Arrow plumbing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch: few, because a row may hold a very long text.
BATCH_ROWS = 512

#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset: a temporary folder in local mode, else
    one beside the warehouse, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local["):
            root = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lakeloom_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared scratch folder. Paths are remembered until discard() or empty_scratch()."""
    path = f"{scratch_root(spark)}/lakeloom/{re.sub(r'[^a-z0-9]+', '-', label)}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared scratch folder and read it back: a lineage cut that survives the loss
    of executors, and one computation for several readers."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


#: Paths of scratch tables that are still there, in the order of their making.
_MADE: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_lakeloom_path", None)
    if path:
        _remove(df.sparkSession, path)


def scratch_mark() -> int:
    """What empty_scratch() takes as the point from which on tables are removed."""
    return len(_MADE)


def empty_scratch(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Remove the scratch tables made since a mark, but for some. Results that were returned read them, so this is for a
    caller who has written its results."""
    kept = {getattr(df, "_lakeloom_path", None) for df in but}
    for path in [p for p in _MADE[since:] if p not in kept]:
        _remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 1 << 17)  # M_MMAP_THRESHOLD: larger blocks go back to the system when they are freed
except (OSError, AttributeError):  # another C library
    _LIBC = None


def release() -> None:
    """Give freed memory back to the system: workers live on from task to task, beside the other processes of an executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, a function on batches, with release() at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


T = TypeVar("T")
_HELD: dict = {}


def worker_state(key: Hashable, make: Callable[[], T]) -> T:
    """The state that a Python worker keeps between batches and tasks. It keeps that of one operator at a time, since
    workers live on from one stage of a pipeline to the next: another key's takes its place."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
    return _HELD[key]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)
