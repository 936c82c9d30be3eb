"""Markdown to heading-aware blocks, by running frames over the lines of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

HEADING = r"^(#{1,6})\s+(.+)"


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line of every document (doc_id, md), trailing space trimmed."""
    return docs.select("doc_id", F.posexplode(tx.lines(F.col("md"))).alias("pos", "line")).withColumn("line", tx.rstrip(F.col("line")))


def classified(lines: DataFrame) -> DataFrame:
    """With fence (a fence line), inside (in or at a fence), level and title of headings, and junk."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    fence = F.col("line").startswith("```")
    upto = F.sum(F.when(fence, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    heading = ~F.col("inside") & F.col("line").rlike(HEADING)
    return (
        lines.withColumn("fence", fence)
        .withColumn("inside", (upto % 2 == 1) | fence)
        .withColumn("level", F.when(heading, F.length(F.regexp_extract("line", HEADING, 1))))
        .withColumn("title", F.when(heading, tx.strip(F.regexp_extract("line", HEADING, 2))))
        .withColumn("junk", ~F.col("inside") & F.col("level").isNull() & tx.strip(F.col("line")).rlike(tx.JUNK))
    )


def heading_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block, heading_stack and text of every block that has text."""
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = classified(lines).withColumn("block", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(frame))
    open_at = [F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(frame) for k in range(1, 7)]
    stack = F.array_compact(F.array(*[F.when(h["level"] == k, h["title"]) for k, h in enumerate(open_at, 1)]))
    body = known.withColumn("heading_stack", stack).where("level is null and not junk")
    found = body.groupBy("doc_id", "block").agg(F.first("heading_stack").alias("heading_stack"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return found.withColumn("text", tx.strip(F.col("text"))).where("text <> ''")


def without_noise(blocks: DataFrame) -> DataFrame:
    """Blocks whose last heading does not name a section to skip."""
    last = F.try_element_at("heading_stack", F.lit(-1))
    return blocks.where(~F.coalesce(last.rlike(tx.SKIPPED), F.lit(False)))


def sub_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, block, part, kind (code, table or text) and text: runs of lines of one kind. A fence belongs to its code; each fence pair is its own run."""
    key = ["doc_id", "block"]
    order = Window.partitionBy(*key).orderBy("pos")
    rows = blocks.select(*key, "heading_stack", F.posexplode(tx.lines(F.col("text"))).alias("pos", "line"))
    fence = F.col("line").startswith("```")
    upto = F.sum(F.when(fence, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("opening", fence & (upto % 2 == 1)).withColumn("code", fence | (upto % 2 == 1))
    rows = rows.withColumn("kind", F.when(F.col("code"), "code").when(F.col("line").rlike(r"^\|.+\|"), "table").otherwise("text"))
    change = F.col("opening") | F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True))
    rows = rows.withColumn("part", F.sum(F.when(change, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(*key, "part", "kind").agg(F.first("heading_stack").alias("heading_stack"), tx.strip(text).alias("text"))
