"""Ingest and index that can be run again: file streams with checkpoints, and anti-joined appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.chunks import chunk_markdown
from docloom.operators.index import CHUNK, ChunkIndex


def index_stream(spark: SparkSession, chunk_dir: str, index: ChunkIndex, embed, checkpoint: str) -> StreamingQuery:
    """Index all chunk files not seen before, then stop. A replayed batch adds nothing, since ids already indexed are left out."""
    rows = spark.readStream.schema(CHUNK).option("recursiveFileLookup", "true").json(chunk_dir)

    def add(batch: DataFrame, _: int) -> None:
        index.add(batch, embed)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(spark: SparkSession, md_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Chunk all markdown tables (Parquet of doc_id, source_file, slice_start, md) not seen before, then stop."""
    rows = spark.readStream.schema("doc_id string, source_file string, slice_start int, md string").parquet(md_dir)

    def write(batch: DataFrame, number: int) -> None:
        chunk_markdown(batch).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out_dir}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
