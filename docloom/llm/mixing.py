"""Mixing sources to target weights.

Each source's documents, in the order of md5(doc_id), form one stream of words,
packed into blocks of BLOCK words. Targets share the wished total by weight; a
target stops at `most` times its source's size and the excess is shared again by
weight, in closed form: target = min(most * size, rate * weight), where rate is
the largest of the rates got by capping the sources one after another in the
order of most * size / weight.

A source's target is a number of slots. Slot j stands in epoch j div blocks and
takes the block that a pseudorandom permutation of the source's full blocks puts
at j mod blocks (swap-or-not rounds: exact for any number, computed per slot; the
last, shorter block ends each epoch). The last slot takes the words still owed,
so a source's words add up to its target, rounded. Each slot draws its output
shard, so the counts of sources per shard are multinomial, given the sources'
totals. Slots meet blocks by (source, block index).

All is DataFrame code and follows from the data and the seed, so reruns agree.
Prefix sums run per (source, md5 prefix) and then over the prefixes, so a source
that holds most rows is spread over PREFIXES parts. Null and empty texts have no
words and are returned with nothing taken. Null is a source, ordered last. Rows
that repeat are rows of their own. No words at all: no targets above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import scratch

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK, SHARDS, SEED, ROUNDS = 128, 64, 20, 20
WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
PRIME = 2_147_483_647
PREFIX = 3
CHUNK, MAX_PARTS = 4_096, 10_000


def sized(docs: DataFrame) -> DataFrame:
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """sid (place of the source, from 1), source, source_size, target and owed (the target in whole words), one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int"))
    every = Window.partitionBy()
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("sid", F.row_number().over(order).cast("long"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", (F.sum("source_size").over(every) * percent - F.col("capped") * 100) / (F.col("open") * 100))
        .withColumn("rate", F.max("rate").over(every))
        .select("sid", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("rate") * F.col("weight")).alias("target"))
        .withColumn("owed", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most).cast("long"))
    )


def round_keys(sid: Column, epoch: Column, n: Column, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """For each round of the permutation of (sid, epoch) its key, and the sum of an index and its partner, modulo n."""

    def one(r: Column) -> Column:
        key = F.pmod(F.pmod(sid * 1_000_003 + epoch * 7_919 + r * 104_729 + seed, F.lit(PRIME)) * 48_271, F.lit(PRIME))
        return F.struct(key.alias("key"), F.pmod(F.pmod(key * 16_807, F.lit(PRIME)) * 69_621, n).alias("sum"))

    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long")), one)


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Where the swap-or-not permutation of 0..n-1 with these round_keys() puts index."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(r["sum"] - x, n)
        once = F.pmod(F.pmod(F.greatest(x, other), F.lit(PRIME)) * 40_014 + r["key"], F.lit(PRIME))
        bit = F.pmod(F.shiftright(F.pmod(once * once + r["key"], F.lit(PRIME)), 9), F.lit(2))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(keys, index, step)


def drawn(sid: Column, slot: Column, shards: int, seed: int = SEED) -> Column:
    """The output shard that a slot draws."""
    key = F.pmod(sid * 1_000_003 + slot * 7_919 + seed, F.lit(PRIME))
    once = F.pmod(key * 40_014 + seed, F.lit(PRIME))
    return F.pmod(F.shiftright(F.pmod(once * once + key, F.lit(PRIME)), 9), F.lit(shards)).cast("int")


def slots(goals: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """sid, slot, epoch, block, words and shard of every slot of the mix."""
    plan = (
        goals.where("owed > 0")
        .withColumn("full", F.expr(f"source_size div {block}"))
        .withColumn("rest", F.expr(f"source_size % {block}"))
        .withColumn("each", F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0))
        .withColumn("epochs", F.expr("owed div source_size"))
        .withColumn("last_full", F.expr(f"least((owed % source_size) div {block}, full)"))
        .withColumn("tail", F.expr(f"owed % source_size - last_full * {block}"))
        .drop("source", "target")
    )
    epochs = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))).withColumn("n_slots", F.when(F.col("epoch") < F.col("epochs"), F.col("each")).otherwise(F.col("last_full") + F.when(F.col("tail") > 0, 1).otherwise(0)))
    chunks = epochs.where("n_slots > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(CHUNK).cast("long"))))
    owed = goals.agg(F.sum("owed")).first()[0] or 0
    parts = chunks.repartition(int(min(MAX_PARTS, owed // (block * CHUNK) + 8)), "sid", "epoch", "first")  # a number given is not coalesced
    keyed = parts.withColumn("keys", round_keys(F.col("sid"), F.col("epoch"), F.greatest("full", F.lit(1))))  # once for all slots of a chunk
    each = keyed.withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("n_slots")) - 1)))
    inside = F.col("i") < F.col("full")
    words = F.when((F.col("epoch") == F.col("epochs")) & (F.col("i") == F.col("last_full")), F.col("tail")).when(inside, F.lit(block)).otherwise(F.col("rest"))
    at = F.when(inside, permuted(F.col("i"), F.col("full"), F.col("keys"))).otherwise(F.col("full"))
    slot = F.col("epoch") * F.col("each") + F.col("i")
    return each.select("sid", slot.alias("slot"), "epoch", at.alias("block"), words.cast("long").alias("words"), drawn(F.col("sid"), slot, shards).alias("shard"))


def streamed(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Each document with sid and `at`, its first word's place in the source's stream, and a number unique in (sid, part)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    known = sizes.join(goals.select("sid", F.col("source").alias("name"), "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    known = known.withColumn("digest", digest).withColumn("part", F.substring("digest", 1, PREFIX))
    inside = Window.partitionBy("sid", "part").orderBy("digest", "doc_id", "size")
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over 16 ** PREFIX rows at most
    starts = known.groupBy("sid", "part").agg(F.sum("size").alias("s")).select("sid", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("part_at"))
    placed = known.withColumn("row", F.row_number().over(inside)).withColumn("at", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(starts, ["sid", "part"]).withColumn("at", F.col("at") + F.col("part_at")).drop("part_at", "digest")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of every document that has words: block, from and to (places in the block)."""
    some = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    start = F.col("block") * block
    return some.withColumn("from", F.greatest(F.col("at") - start, F.lit(0))).withColumn("to", F.least(F.col("at") + F.col("size") - start, F.lit(block)))


def uses(drawn: DataFrame) -> DataFrame:
    """Per (sid, block) the words taken by each of its slots, one an epoch, and the slot's shard."""
    shard = lambda e: F.max(F.when(F.col("epoch") == e, F.col("shard"))).alias(f"s{e}")
    return drawn.groupBy("sid", "block").agg(shard(0), shard(1), F.sum(F.when(F.col("epoch") == 0, F.col("words")).otherwise(0)).alias("w0"), F.sum(F.when(F.col("epoch") == 1, F.col("words")).otherwise(0)).alias("w1"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix, repeats counted) and shards (the output shards these words go to, with their number) of every row."""
    sizes = scratch(sized(docs), "sizes")
    goals = scratch(targets(sizes), "goals")
    placed = scratch(streamed(sizes, goals), "placed")
    key = ["sid", "part", "row"]
    use = lambda e: F.struct(F.col(f"s{e}").alias("shard"), F.greatest(F.lit(0), F.least(F.col("to"), F.col(f"w{e}")) - F.col("from")).cast("long").alias("words"))
    met = pieces(placed, block).select(*key, "block", "from", "to").join(uses(slots(goals, block)), ["sid", "block"]).select(*key, F.explode(F.array(use(0), use(1))).alias("use"))
    each = met.where("use.words > 0").groupBy(*key, "use.shard").agg(F.sum("use.words").alias("words"))
    taken = each.groupBy(*key).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))  # SHARDS at most
    none = F.expr("cast(array() as array<struct<shard: int, words: bigint>>)")
    return placed.join(taken, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of docs, one row for each epoch in which the mix takes words of a document: all of its text, or the words taken, joined by spaces; other columns as they are."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"({WORD})"))
    sizes = scratch(sized(docs), "sizes")
    goals = scratch(targets(sizes), "goals")
    placed = scratch(streamed(sizes, goals), "placed")
    drawn = uses(slots(goals, block))
    cut = lambda w: F.struct((F.greatest(F.col("block") * block - F.col("at"), F.lit(0))).cast("int").alias("a"), (F.col("block") * block + F.least(F.col("to"), F.col(w)) - F.col("at")).cast("int").alias("b"))
    both = pieces(placed, block).join(drawn, ["sid", "block"]).select("doc_id", "size", "source", "sid", "part", "row", F.explode(F.array(F.struct(F.lit(0).alias("epoch"), cut("w0").alias("span")), F.struct(F.lit(1).alias("epoch"), cut("w1").alias("span")))).alias("use"))
    kept = both.where("use.span.b > use.span.a").groupBy("doc_id", "source", "size", "sid", "part", "row", "use.epoch").agg(F.sort_array(F.collect_list("use.span")).alias("spans"), F.sum(F.col("use.span.b") - F.col("use.span.a")).alias("n"))
    rows = docs.withColumn("size", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")).withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text"))))
    several = kept.withColumn("copy", F.dense_rank().over(Window.partitionBy("doc_id", "source", "size").orderBy("row")))
    match = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size")) & (F.col("l.copy") == F.col("r.copy"))
    found = rows.alias("l").join(several.select("doc_id", "source", "size", "copy", "spans", "n").alias("r"), match).select("l.*", "r.spans", "r.n")
    chosen = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice("all_words", s["a"] + 1, s["b"] - s["a"]))), " ")
    text = F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(chosen)
    out = found.withColumn("all_words", words).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
