"""What the operators share: scratch tables, worker imports, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.arrow import BATCH, BATCH_BYTES, BATCH_ROWS, BYTES, ROOT, small_batches, trim, workers_import  # noqa: F401
from docloom.sources.tables import forget, recorded, remove, scratch, scratch_dir  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker keeps for its next task: one thing at most, since workers outlive the operator that filled them.
_kept: dict = {}


def keep(key: tuple, make: Callable[[], object]) -> object:
    """What the worker keeps under this key, made anew unless it is what was kept last."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what the worker keeps and give its memory back."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, fn, schema: str | T.StructType, keeps: bool = False) -> DataFrame:
    """mapInArrow, in batches of about BATCH_ROWS and BATCH_BYTES at most; unless fn keeps something itself, its tasks first drop what another operator left in the worker. A task that ends gives its free memory back."""
    workers_import(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.enable()
        if not keeps:
            release()
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about `limit` bytes of text each (one row at least), null texts as empty."""
    for batch in batches:
        texts = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > limit:
                part = batch.slice(begin, i - begin)
                yield part, [t or "" for t in texts.slice(begin, i - begin).to_pylist()]
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin), [t or "" for t in texts.slice(begin).to_pylist()]


def record_batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if not isinstance(columns[k], (pa.Array, pa.ChunkedArray)) else columns[k] for k, t in types.items()], names=list(types))


def rank_in(ordered: list[str], key: Column) -> Column:
    """How many of the ordered strings are <= key, by binary search in a folded literal. The list's size must be bounded."""
    if not ordered:
        return F.lit(0)
    steps = [1 << b for b in range(len(ordered).bit_length() - 1, -1, -1)]
    values = F.split(F.lit(",".join(ordered)), ",")
    n = len(ordered)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(values, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at),
    )
