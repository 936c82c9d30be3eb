"""What all that goes to Python in Arrow batches shares: bounds on a batch, imports of workers, free memory given back."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows of a batch to Python: each worker and its executor hold a batch of whole texts, and operators regroup rows by bytes.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
#: Bytes of a batch to Python, unless the session sets them: some rows are bundles or sets, of megabytes each. A larger row is a batch of its own.
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def small_batches(spark: SparkSession | None = None) -> None:
    """From now on batches to Python hold about BATCH_ROWS and BATCH_BYTES at most, in this session or the active one."""
    spark = spark or SparkSession.active()
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    if spark.conf.get(BYTES, None) is None:
        spark.conf.set(BYTES, BATCH_BYTES)


def trim() -> None:
    """Return to the system what is free in this worker's allocators: else an idle worker keeps the most that any task needed."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if give_back:
        give_back(ctypes.c_size_t(0))


def map_small(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in small batches; a task that ends gives its free memory back."""
    workers_import(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)
