"""Shards of near equal size through sampled splitters.

Records are ordered by the digest of their text, then by that of their doc_id,
so equal texts stand together. Size-weighted samples of these keys give quantile
boundaries of many fine ranges, a few dozen to a shard, and each record is placed
in its range. A group of equal texts never straddles ranges unless it is larger
than one GROUP_PARTth of a shard and than any single record, which no shard can
avoid; such overfull keys are subdivided by doc_id. With the
sizes of the ranges known, each record has its exact offset in the whole order,
and a shard is the interval that holds the record's middle. Groups up to that
size move as one.

Only ranges are gathered in one place: at most MAX_RANGES, as are samples per
range. Everything is DataFrame code. Null texts have no bytes and form a group of
their own; empty tables give no rows; identical rows get places of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import rank_in, scratch

SHARDS, OVERHEAD = 40, 16
RANGES_PER_SHARD, MAX_RANGES, SAMPLES_PER_RANGE = 16, 16_384, 8
RANGE_BYTES = 256 << 20
GROUP_PART = 64
NO_TEXT = "0" * 32


def keyed(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit(NO_TEXT)).alias("k"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 1, 16).alias("h"),
    )


def boundaries(records: DataFrame, total: int, ranges: int, limit: int) -> tuple[list[str], list[str]]:
    """Quantile keys from a size-weighted sample, and the keys of groups larger than limit among them."""
    weight = F.col("size") * float(ranges * SAMPLES_PER_RANGE) / float(total)
    drawn = F.pmod(F.xxhash64("h", "doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30) < weight
    sample = sorted((r.k + r.h, r.w) for r in records.where(drawn).select("k", "h", F.greatest(weight, F.lit(1.0)).alias("w")).collect())
    step, held, found = sum(w for _, w in sample) / ranges, 0.0, []
    for key, w in sample:
        held += w
        if held >= step * (len(found) + 1) and len(found) < ranges - 1:
            found.append(key)
    groups = sorted({key[:32] for key in found})
    if not groups:
        return [], []
    sizes = records.where(F.get(F.split(F.lit(",".join(groups)), ","), F.greatest(rank_in(groups, F.col("k")) - 1, F.lit(0))) == F.col("k")).groupBy("k").agg(F.sum("size").alias("s")).where(F.col("s") > limit)
    large = {r.k for r in sizes.collect()}
    return sorted({key if key[:32] in large else key[:32] for key in found}), sorted(large)


def among(ordered: list[str], key: Column) -> Column:
    if not ordered:
        return F.lit(False)
    return F.get(F.split(F.lit(",".join(ordered)), ","), F.greatest(rank_in(ordered, key) - 1, F.lit(0))) == key


def shards(docs: DataFrame, n_shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    records = scratch(keyed(docs, overhead), "records")
    total, largest = (x or 0 for x in records.agg(F.sum("size"), F.max("size")).first())
    limit = max(total // (n_shards * GROUP_PART), largest)
    ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * n_shards, total // RANGE_BYTES))
    cuts, large = boundaries(records, total, ranges, limit) if total else ([], [])

    ranged = records.withColumn("range", rank_in(cuts, F.concat("k", "h")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over at most MAX_RANGES rows
    starts = ranged.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("range_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_row"))
    inside = Window.partitionBy("range").orderBy("k", "h", "doc_id", "size")
    own = Window.partitionBy("range", "k")
    placed = (
        ranged.withColumn("at", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.row_number().over(inside) - 1)
        .withColumn("group_size", F.sum("size").over(own))
        .withColumn("group_at", F.min("at").over(own))
        .join(F.broadcast(starts), "range")  # at most MAX_RANGES rows
    )
    alone = among(large, F.col("k")) | (F.col("group_size") > limit)
    middle = 2 * F.col("range_at") + F.when(alone, 2 * F.col("at") + F.col("size")).otherwise(2 * F.col("group_at") + F.col("group_size"))
    shard = F.expr(f"cast(least(middle * {n_shards} div {2 * max(total, 1)}, {n_shards - 1}) as int)")
    ranked = scratch(placed.withColumn("middle", middle).select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("range_row") + F.col("row")).alias("row")), "ranked")
    firsts = ranked.groupBy("shard").agg(F.min("row").alias("first"))
    return ranked.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
