"""Chunk table: ids, flags, order and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.models import Embedder, SentenceSplitter
from docloom.operators.blocks import heading_blocks, line_table, without_noise
from docloom.operators.segments import windows

PAGES = 20


def page_slices(docs: DataFrame) -> DataFrame:
    """doc_id, start, end of the half-open slices of PAGES pages of each document (doc_id, n_pages)."""
    return docs.where("n_pages > 0").select("doc_id", "n_pages", F.explode(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1, F.lit(PAGES))).alias("start")).select("doc_id", "start", F.least(F.col("start") + PAGES, F.col("n_pages").cast("int")).alias("end"))


def assembled(found: DataFrame) -> DataFrame:
    """Chunks of windows (doc_id, source_file, slice_start, block, part, piece, ...), numbered within their slice."""
    local = F.row_number().over(Window.partitionBy("doc_id", "slice_start").orderBy("block", "part", "piece")) - 1
    full = F.concat(tx.heading_prefix(F.col("heading_stack")), F.col("text"))
    return found.withColumn("local", local).select(
        tx.chunk_id(F.col("doc_id"), F.col("local"), full).alias("chunk_id"), "doc_id", "source_file", "slice_start", "local",
        F.col("heading_stack").alias("section_path"), F.try_element_at("heading_stack", F.lit(-1)).alias("heading"), full.alias("text"), F.length(full).cast("long").alias("char_count"),
        F.coalesce("w_table", tx.has_table(F.col("text"))).alias("has_table"), tx.has_formula(F.col("text")).alias("has_formula"), F.coalesce("w_code", tx.has_code(F.col("text"))).alias("has_code"),
    )


def linked(chunks: DataFrame) -> DataFrame:
    """With chunk_index over the whole document and the ids before and after; chunk ids keep their slice's number."""
    order = Window.partitionBy("doc_id").orderBy("slice_start", "local")
    return chunks.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long")).withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))


def chunk_markdown(docs: DataFrame, splitter: SentenceSplitter | None = None, embedder: Embedder | None = None, overlap: int = 0) -> DataFrame:
    """The chunk table of markdown documents (doc_id, source_file, slice_start, md). Sentences are split and compared by models, or by stand-ins; `overlap` of them are repeated at the start of the next piece."""
    keyed = docs.withColumn("key", F.concat_ws("\x1f", "doc_id", F.col("slice_start").cast("string")))
    found = windows(without_noise(heading_blocks(line_table(keyed.select(F.col("key").alias("doc_id"), "md")))), splitter, embedder, overlap).withColumnRenamed("doc_id", "key")
    named = found.join(keyed.select("key", "doc_id", "source_file", "slice_start"), "key").drop("key")
    return linked(assembled(named)).drop("slice_start", "local")
