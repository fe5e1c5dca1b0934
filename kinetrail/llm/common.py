"""Shared helpers: the scratch folder all machines see, written intermediate tables, row keys, free column names."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id among keys.
NO_ID = -(2**63)
#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows a task puts out until it gives freed memory back.
TRIM = 1 << 23


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a
    cluster it is an error, as executors would write to folders of their own."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and a lost executor loses nothing. The
    shuffle files of the write go as soon as it is done; else they stay until the driver's next garbage collection."""
    path, conf = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored() tables that no later plan reads."""
    for t in tables:
        if path := t.__dict__.get("stored_at"):
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(task: Task) -> Task:
    """A task that gives freed memory back as it goes, and at its end: workers are used again by later stages, and would
    keep it."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        try:
            for out in task(batches):
                size += out.nbytes
                yield out
                if size > TRIM:
                    size = 0
                    give_back()
        finally:
            give_back()

    return run


def bounded(docs: DataFrame, rows: int = 1000, size: int = 1 << 22) -> DataFrame:
    """docs; from here on the session's Arrow batches hold at most `rows` rows and end with the row that reaches `size`
    bytes, since a row here is a whole text and a worker, and the executor that feeds it, hold a batch or two at a time."""
    conf = docs.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(conf.get(name).rstrip("bB")) <= most:
            conf.set(name, str(most))
    return docs


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows (_id, _th, text, keep...): a never-null document id (null becomes the smallest long, so it comes first)
    and a 64-bit hash of the text, which together name a row; rows that repeat in full share a name and fare alike."""
    return bounded(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.col("text")).alias("_th"),
        F.col("text").cast("string").alias("text"),
        *keep,
    )


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
