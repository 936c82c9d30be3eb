"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model runs over the UTF-16 units of a text, each as it is, in n-grams of
ORDER, begun by ORDER - 1 zeros. An n-gram is one long of 16 bits a unit, so its
context and its lower orders are shifts and masks of it. The n-grams of the
trusted texts (labelled quality 1 and not toxic), their counts and what their
contexts leave to lower orders are tables, one a order, which grow with the
text; lower orders count in how many contexts their n-gram continues. Discounts
for counts 1, 2 and 3+ come from the counts of counts, as Chen and Goodman give
them; below order 1 all units are as likely.

Texts are not shuffled row by row. They are packed once into compressed bundles
of about BUNDLE bytes, a table bucketed by the bundle's number; labels meet
it by number and place. For scoring, the distinct n-grams of each bundle are
joined, sharded by n-gram, with their costs (which come from joins of the
corpus's distinct n-grams with the tables of all orders), and the costs go back
to their bundle, in the same buckets. There each text's costs are summed.

A document's score is the negative log probability of its units, per unit (the
log of its perplexity). Every HOLD-th trusted document, by a hash of doc_id, is
left out of the counts, as texts that were counted score too well; a document is
kept if its score is at most the QUANTILE of theirs in its language, or of all of
them where a language has fewer than LEAST, and MARGIN more, as few documents
tell a high quantile only roughly. Texts that are null or empty have no score
and are not kept; null is a language of its own. Without trusted text nothing
is rejected but such texts. Equal texts of a language are judged alike. Labels
that repeat a doc_id count once; a label that is null does not count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import groups, map_arrow, record_batch, recorded, remove, scratch, scratch_dir

ORDER, BITS = 4, 16
UNITS = 1 << BITS
HOLD = 5
QUANTILE, MARGIN, LEAST = 0.995, 0.05, 50
BUNDLE = 12 << 20
HELD_GRAMS = 4_000_000
SLOTS = 20


# --- n-grams of texts ---------------------------------------------------------
def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams that end at each unit of the texts, and where each text's begin and end."""
    lead = "\0" * (ORDER - 1)
    raw = (lead + lead.join(t.replace("\0", "\1") for t in texts) + lead).encode("utf-16-le", "surrogatepass")
    units = np.frombuffer(raw, np.uint16).astype(np.uint64)
    n = len(units) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out <<= np.uint64(BITS)
        out |= units[k : k + n]
    lengths = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts])
    begin = np.cumsum(lengths + ORDER - 1) - lengths - ORDER + 1
    return out, begin, begin + lengths


def inside(found: np.ndarray) -> np.ndarray:
    """Those n-grams that end in a unit of a text, not in a zero before one."""
    return found[(found & np.uint64(UNITS - 1)) != 0]


class Costs:
    """Cost by n-gram: a table with a slot for most, binary search for those whose slot another has."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.costs = keys[order], costs[order].astype(np.float64)
        self.slot = np.zeros(1 << SLOTS, np.int32)
        self.slot[self.place(self.keys)] = np.arange(len(keys))

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.intp)

    def of(self, found: np.ndarray) -> np.ndarray:
        at = self.slot.take(self.place(found))
        other = np.flatnonzero(self.keys.take(at) != found)
        at[other] = np.minimum(np.searchsorted(self.keys, found[other]), len(self.keys) - 1)
        return self.costs.take(at)


# --- bundles ------------------------------------------------------------------
def rows_of(stored: bytes) -> Iterator[pa.RecordBatch]:
    return iter(pa.ipc.open_stream(stored))


def bundled(rows: DataFrame, fields: list[str]) -> tuple[str, str]:
    """Rows packed into a bucketed table: bundle (a number), stored (rows as a compressed Arrow stream), ids (of doc_id, in order) and grams (distinct n-grams); and the table's name and path."""
    text_at, id_at = fields.index("text"), fields.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"bundle": pa.int64(), "stored": pa.binary(), "ids": pa.list_(pa.int64()), "grams": pa.list_(pa.int64())}
        task, number = TaskContext.get().partitionId(), 0
        held, size, seen = [], 0, np.empty(0, np.uint64)

        def emit() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            ids = np.concatenate([pc.cast(p.column(id_at), pa.int64()).to_pylist() for p in held])
            return record_batch({"bundle": [task << 32 | number], "stored": [sink.getvalue().to_pybytes()], "ids": [ids.tolist()], "grams": [seen.view(np.int64)]}, types)

        for part, texts in groups((pa.RecordBatch.from_struct_array(b.column(0)) for b in batches), text_at):
            seen = np.union1d(seen, inside(grams(texts)[0]))
            held.append(part)
            size += sum(map(len, texts))
            if size >= BUNDLE:
                yield emit()
                number += 1
                held, size, seen = [], 0, np.empty(0, np.uint64)
        if held:
            yield emit()

    spark = rows.sparkSession
    name, path = f"docloom_bundles_{uuid.uuid4().hex}", f"{scratch_dir(spark)}/bundles-{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    packed = map_arrow(rows, run, "bundle long, stored binary, ids array<long>, grams array<long>")
    packed.write.option("path", path).bucketBy(buckets, "bundle").saveAsTable(name, format="parquet")
    return name, path


def beside(bundles: DataFrame, facts: DataFrame) -> DataFrame:
    """stored with facts on their bundle. The bundles stay where they are: only the facts are shuffled, to their buckets."""
    return bundles.select("bundle", "stored").join(facts.hint("shuffle_hash"), "bundle").drop("bundle")


# --- model -----------------------------------------------------------------------
def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def left_out() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(HOLD)) == 0


def gram_counts(bundles: DataFrame, good: DataFrame, text_at: int) -> DataFrame:
    """gram and n, over the texts whose doc_id is in good; summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"gram": pa.int64(), "n": pa.int64()}
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def emit() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                yield record_batch({"gram": keys[at : at + 100_000].view(np.int64), "n": counts[at : at + 100_000]}, types)

        for batch in batches:
            for stored, places in zip(batch.column(0), batch.column(1), strict=True):
                wanted, at = set(places.as_py()), 0
                for part in rows_of(stored.as_py()):
                    texts = [t for i, t in enumerate(part.column(text_at).to_pylist(), at) if i in wanted and t]
                    at += part.num_rows
                    if texts:
                        found, times = np.unique(inside(grams(texts)[0]), return_counts=True)
                        both = np.concatenate([keys, found])
                        keys, where = np.unique(both, return_inverse=True)
                        counts = np.bincount(where, np.concatenate([counts, times]), len(keys)).astype(np.int64)
                if len(keys) > HELD_GRAMS:
                    yield from emit()
                    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield from emit()

    places = bundles.select("bundle", F.posexplode("ids").alias("place", "doc_id")).join(good, "doc_id", "left_semi").groupBy("bundle").agg(F.collect_list("place").alias("places"))
    return map_arrow(beside(bundles, places), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; 0.5, 1 and 1.5 where the counts of counts give none."""
    n1, n2, n3, n4 = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def discounted(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def lower(gram: str, order: int) -> Column:
    """The last `order` units of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * order) - 1))


def context(gram: str, order: int) -> Column:
    """All units but the last of an n-gram of this order."""
    return F.shiftrightunsigned(gram if order == ORDER else lower(gram, order), BITS)


def model(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: n-grams (g) with p, and contexts (c) with the weight that each leaves to the lower order."""
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # in how many contexts an n-gram continues
        tables[order] = scratch(tables[order + 1].groupBy(lower("gram", order).alias("gram")).agg(F.count("*").alias("n")), f"order{order}")
    out = []
    for order in range(1, ORDER + 1):
        d = discounts(tables[order])
        known = tables[order].withColumn("c", context("gram", order))
        totals = known.groupBy("c").agg(F.sum("n").alias("total"), F.sum(discounted(d)).alias("left"))
        contexts = scratch(totals.select("c", (F.col("left") / F.col("total")).alias("weight"), "total"), f"contexts{order}")
        own = (F.col("n") - discounted(d)) / F.col("total")
        full = known.join(contexts, "c")
        if order == 1:
            full = full.withColumn("q", F.lit(1 / UNITS))
        else:
            full = full.withColumn("g", lower("gram", order - 1)).join(out[-1][0].withColumnRenamed("p", "q"), "g").drop("g")
        p = scratch(full.select(F.col("gram").alias("g"), (own + F.col("weight") * F.col("q")).alias("p")), f"p{order}")
        out.append((p, contexts.select("c", "weight")))
    return out


def costs(asked: DataFrame, orders: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram and cost (negative log probability) of distinct n-grams, seen or not."""
    found, p = asked, F.lit(1 / UNITS)
    for order in range(ORDER, 0, -1):
        seen, contexts = orders[order - 1]
        small = (lambda t: F.broadcast(t)) if order == 1 else (lambda t: t)  # UNITS rows at most
        found = found.withColumn("g", F.col("gram") if order == ORDER else lower("gram", order)).join(small(seen), "g", "left").drop("g").withColumnRenamed("p", f"p{order}")
        small = (lambda t: F.broadcast(t)) if order <= 2 else (lambda t: t)
        found = found.withColumn("c", context("gram", order)).join(small(contexts), "c", "left").drop("c").withColumnRenamed("weight", f"w{order}")
    for order in range(1, ORDER + 1):
        p = F.coalesce(f"p{order}", F.coalesce(f"w{order}", F.lit(1.0)) * p)
    return found.select("gram", (-F.log(p)).cast("float").alias("cost"))


# --- scores ------------------------------------------------------------------------
def scored(bundles: DataFrame, orders: list[tuple[DataFrame, DataFrame]], row: T.StructType, text_at: int) -> DataFrame:
    """row, n_symbols and score of every row packed."""
    pairs = bundles.select("bundle", F.explode("grams").alias("gram"))
    priced = scratch(costs(pairs.select("gram").distinct(), orders), "costs")
    sheets = pairs.join(priced.hint("shuffle_hash"), "gram").groupBy("bundle").agg(F.collect_list("gram").alias("grams"), F.collect_list("cost").alias("costs"))
    all_sheets = bundles.select("bundle").where(F.size("grams") == 0).withColumn("grams", F.expr("cast(array() as array<long>)")).withColumn("costs", F.expr("cast(array() as array<float>)")).unionByName(sheets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, values = (batch.column(k)[i].values.to_numpy() for k in (1, 2))
                table = Costs(keys.view(np.uint64), values) if len(keys) else None
                for part in rows_of(batch.column(0)[i].as_py()):
                    found, begin, end = grams([t or "" for t in part.column(text_at).to_pylist()])
                    if table is None:
                        sums = np.zeros(part.num_rows)
                    else:
                        own = (found & np.uint64(UNITS - 1)) != 0
                        cost = np.zeros(len(found) + 1)
                        cost[1:][own] = table.of(found[own])
                        total = np.cumsum(cost)
                        sums = total[end] - total[begin]
                    n = end - begin
                    score = pa.array(sums / np.maximum(n, 1), mask=n == 0)
                    yield pa.RecordBatch.from_arrays([part.to_struct_array(), pa.array(n, pa.int64()), score], names=["row", "n_symbols", "score"])

    out = T.StructType([T.StructField("row", row), T.StructField("n_symbols", T.LongType()), T.StructField("score", T.DoubleType())])
    return map_arrow(beside(bundles, all_sheets), run, out)


def lm_quality(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, n_symbols, score, perplexity, threshold (on the score) and kept of every row; with carry, all columns of docs as `row` instead of doc_id and lang."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row")) if carry else docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").alias("row"))
    struct = rows.schema["row"].dataType
    text_at = struct.fieldNames().index("text")
    good = scratch(trusted(labels), "trusted")
    name, path = bundled(rows, struct.fieldNames())
    bundles = spark.table(name)
    with recorded() as tables:
        orders = model(scratch(gram_counts(bundles, good.where(~left_out()), text_at), "grams"))
    found = scored(bundles, orders, struct, text_at)
    whole = ["row"] if carry else []
    scores = scratch(found.select(*whole, F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.lang").cast("string").alias("lang"), "n_symbols", "score"), "scores")
    spark.sql(f"DROP TABLE {name}")
    for unused in (path, *tables):
        remove(spark, unused)

    own = scores.where("score is not null").select("doc_id", "lang", "score").join(good.where(left_out()), "doc_id", "left_semi")
    quantile = F.percentile_approx("score", QUANTILE, 10_000).alias("q")
    per_lang = own.groupBy("lang").agg(F.count("*").alias("n"), quantile).where(F.col("n") >= LEAST).select(F.col("lang").alias("of"), "q")
    overall = own.agg(quantile).first()["q"]
    limit = F.coalesce("q", F.lit(overall).cast("double"), F.lit(float("inf"))) + MARGIN
    judged = (
        scores.join(F.broadcast(per_lang), F.col("lang").eqNullSafe(F.col("of")), "left")  # a row for each language
        .withColumn("threshold", limit)
        .withColumn("kept", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(False)))
    )
    return judged.select(*(whole or ["doc_id", "lang"]), "n_symbols", "score", F.exp("score").alias("perplexity"), "threshold", "kept")
