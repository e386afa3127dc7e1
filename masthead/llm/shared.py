"""Scratch tables, column naming and Arrow helpers that the operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go when a *local* session names no shared folder.
LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; a cluster
    session without it is refused, because a machine-local folder would lose
    files as soon as another executor reads them.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_SCRATCH)
    return LOCAL_SCRATCH


#: Shuffle files go when a write has ended, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, *used: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and it gives the
    planner real sizes.  The columns keep their names and types.  ``used`` are
    materialized tables that nobody reads after this; they are removed.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/masthead/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    discard(*used)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables; other frames are left alone."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(column: str = "text"):
    """The text column as a string, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What empties the caches that modules keep in a Python worker.
AT_TASK_END: list[Callable[[], object]] = []


def release() -> None:
    """Empty the caches and give freed memory back to the machine: Arrow's pool, then the allocator's."""
    for empty in AT_TASK_END:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function for ``mapInArrow`` that keeps nothing when the task ends.

    Python workers are used again by later tasks of any stage, next to the JVM's
    heap; what one stage leaves in them would be missing in the next.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task
