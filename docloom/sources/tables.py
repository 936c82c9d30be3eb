"""Tables that operators keep between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


_recording: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the scratch tables made within."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording[:] = [p for p in _recording if p is not paths]


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _recording:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
