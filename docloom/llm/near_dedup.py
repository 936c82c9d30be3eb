"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set holds the hashes of its distinct runs of `shingle` lower-cased
words (A-Z only); with fewer words, the whole sequence is the one element. In
SuperMinHash each element walks one random permutation of the signature's slots
and offers slot p[j] the value j + r, so the slots of an element are correlated
and the signature varies less than with independent hashes; a walk ends when no
slot holds more than its level (early stopping).

Documents with equal sets form a class, named by its smallest doc_id; only
classes go on. Those that agree in a band of the signature share a bucket, and
buckets that share members make up a family, by union-find over small integers.
Every two sets of a family are compared, whole, in blocks of bounded size: a
small family is one block; a large one is cut by size of the sets (more than a
size class apart, two sets cannot be similar enough) and by a hash. A block's
intersections are one matrix product over the elements that two of its sets
hold, and it gives out a spanning forest of its links, never the pairs.
Large families take two rounds: each block against the first ones, which joins
most copies; then all blocks of members outside the family's largest component
(strays) against all its blocks. So every pair is compared or already joined.
Links are grouped by union-find: within each partition first, then by
alternating star contractions until nothing changes.

Null and empty texts, and texts of white space, have no element and link with
nothing. Rows that repeat a doc_id share its component,
whatever their texts. Rows without doc_id
link with nothing and are not kept. Only doc_id and text are read. The chance
to miss a link of similarity 0.8 by banding is (1 - 0.8**4)**32, below 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, groups, map_arrow, record_batch, scratch
from docloom.llm.textbytes import mix, runs, word_hashes, word_spans

SLOTS, BANDS = 128, 32
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.array([(k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(SLOTS)], np.uint64)
LOW = np.uint64(0xFFFFFFFF)
#: Most members and elements that a block is meant to hold; hashing makes these means.
MEMBERS, ELEMENTS = 128, 200_000
COLUMNS = 8192
SALTS = 16


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, A-Z lower-cased, and where each text starts."""
    raw = [t.encode() for t in texts]
    joined = np.frombuffer(b"\n".join(raw), np.uint8).copy()
    joined[(joined - np.uint8(65)) < 26] += np.uint8(32)
    return joined, np.cumsum([0] + [len(r) + 1 for r in raw])


def element_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct element hashes of each text."""
    raw, begin = lowered(texts)
    starts, ends = word_spans(raw)
    hashes = word_hashes(raw, starts, ends)
    cut = np.searchsorted(starts, begin)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = hashes[a:b]
        out.append(np.unique(runs(own, min(shingle, len(own)))) if len(own) else own)
    return out


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signature of a non-empty array of distinct elements: level << 32 | random, the least in each slot."""
    out = np.full(slots, np.uint64(slots) << np.uint64(32))
    order = None
    for level in range(slots):
        x = mix(elements + STEPS[level])
        pick = (((x >> np.uint64(32)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.intp) + level
        if level == 0:
            place, first = pick, pick
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                rows = np.arange(len(elements))
                order[rows, first], order[:, 0] = 0, first
            place = order[rows, pick].astype(np.intp)
            order[rows, pick] = order[:, level]
            order[:, level] = place
        np.minimum.at(out, place, np.uint64(level) << np.uint64(32) | (x & LOW))
        if int(out.max()) < (level + 1) << 32:
            break
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) * GOLDEN
    for k in range(rows.shape[1]):
        key = mix(key + rows[:, k] + GOLDEN)
    return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, two order-free digests of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            sets = element_sets(texts, shingle)
            sums = lambda salt: [int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            bands = [band_keys(superminhash(s)) if len(s) else np.empty(0, np.int64) for s in sets]
            yield record_batch({"doc_id": part.column(0), "n_shingles": list(map(len, sets)), "d1": sums(1), "d2": sums(2), "bands": bands}, {"doc_id": pa.int64(), "n_shingles": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "bands": pa.list_(pa.int64())})

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def set_table(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id and elements (sorted uint64) of the documents named; a doc_id with several texts has a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            yield record_batch({"doc_id": part.column(0), "elements": [s.tobytes() for s in element_sets(texts, shingle)]}, {"doc_id": pa.int64(), "elements": pa.binary()})

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    return map_arrow(wanted.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select("doc_id", "text"), run, "doc_id long, elements binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets of distinct elements."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    values = np.concatenate(sets)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    same = values[1:] == values[:-1]
    held = np.r_[same, False] | np.r_[False, same]  # by two sets or more
    first = np.r_[True, ~same][held]
    owner, column = owner[held], np.cumsum(first) - 1
    out = np.zeros((len(sets), len(sets)), np.int64)
    np.fill_diagonal(out, list(map(len, sets)))
    alone = out.diagonal() - np.bincount(owner, minlength=len(sets))
    cuts = [*np.searchsorted(column, np.arange(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS)).tolist(), len(column)]
    common = np.zeros_like(out)
    for a, b in zip(cuts, cuts[1:]):
        wide = np.zeros((len(sets), min(COLUMNS, int(column[b - 1] - column[a]) + 1)), np.float32)
        wide[owner[a:b], column[a:b] - column[a]] = 1
        common += (wide @ wide.T).astype(np.int64)
    return common + np.diag(alone)


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links (a, b) that join the same sets as all links with 100 * intersection >= percent * union."""
    common = intersections(sets)
    sizes = common.diagonal()
    links = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    left, a, b = np.ones(len(ids), bool), [], []
    for i in range(len(ids)):
        edge = np.array([i]) if left[i] else ()
        left[i] = False
        while len(edge):
            edge = np.flatnonzero(links[edge].any(axis=0) & left)
            left[edge] = False
            a += ids[edge].tolist()
            b += [int(ids[i])] * len(edge)
    return a, b


def linked(ship: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Forests (a, b) of the links within each task's sets; ship says which sets (rep) each task holds.

    A table, so that no task of what reads it needs a second Python worker beside the one that compares sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"a": pa.int64(), "b": pa.int64()}
        now, ids, held = None, [], []
        for batch in batches:
            for task, rep, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if task != now and ids:
                    yield record_batch(dict(zip("ab", forest(np.array(ids), held, percent), strict=True)), types)
                    ids, held = [], []
                now = task
                ids.append(rep)
                held.append(np.frombuffer(raw.as_py(), np.uint64))
        if ids:
            yield record_batch(dict(zip("ab", forest(np.array(ids), held, percent), strict=True)), types)

    rows = ship.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("task", "rep", "elements")
    return scratch(map_arrow(rows.repartition("task").sortWithinPartitions("task"), run, "a long, b long"), "compared")


def forests(edges: DataFrame) -> DataFrame:
    """Per partition, union-find over its edges (a, b): each node with its smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def emit() -> pa.RecordBatch:
            nodes = [x for x in parent if root(x) != x]
            return record_batch({"a": nodes, "b": list(map(root, nodes))}, {"a": pa.int64(), "b": pa.int64()})

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:  # bounded memory: a forest so far, then anew
                yield emit()
                parent.clear()
        yield emit()

    return map_arrow(edges.select("a", "b"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a that is not the smallest of its component, b being that smallest, from links (a, b)."""
    ordered = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch(ordered(forests(edges)), "links")
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # a table, so that adaptive execution can split the join where one a has many b
        large = ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, scratch(ordered(small), "links")
        forget(before, least)
    return now


def are_stars(edges: DataFrame) -> bool:
    """Whether each a has one b, which is no a itself: then every b is the smallest of its component."""
    ends = edges.select("a", F.lit(1).alias("own"), F.lit(0).alias("met")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("own"), F.lit(1).alias("met")))
    return ends.groupBy("a").agg(F.sum("own").alias("own"), F.max("met").alias("met")).where("own > 1 or own = 1 and met = 1").isEmpty()


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the facts on their keys, in SALTS parts of each key, as one family may hold most rows."""
    parts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS).cast("long"))).join(parts, [*keys, "salt"]).drop("salt")


def size_class(percent: int) -> Column:
    """Sets that are similar enough have sizes n in the same class or in neighbouring ones."""
    return (F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")).cast("long")


def blocks_needed(cells: Column, elements: Column) -> Column:
    return F.ceil(F.greatest(cells / MEMBERS, elements / ELEMENTS)).cast("int")


def placed(rows: DataFrame) -> DataFrame:
    """rows (rep, n, g, c, top), each with its block k among those of its family g, size class c and flag top."""
    cells = rows.groupBy("g", "c", "top").agg(blocks_needed(F.count("*"), F.sum("n")).alias("blocks"))
    return looked_up(rows, cells, ["g", "c", "top"]).withColumn("k", F.pmod(F.xxhash64("rep", "g"), F.col("blocks")).cast("int"))


def shipped(place: DataFrame, wanted: Column) -> DataFrame:
    """(rep, task) for every pair of blocks x, y of a family, in equal or neighbouring size classes, that is wanted.

    Two tasks whose hashes were equal would be done as one, which loses nothing.
    """
    key = ["c", "top", "k"]
    blocks = place.select("g", "blocks", *key).distinct()
    x = blocks.select("g", F.struct(*key).alias("x"), F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("yc"))
    y = blocks.select("g", F.struct(*key).alias("y"), F.col("c").alias("yc"))
    pairs = x.join(y, ["g", "yc"]).where(F.col("x") <= F.col("y")).where(wanted)
    sides = pairs.select("g", F.xxhash64("g", "x", "y").alias("task"), F.explode(F.array_distinct(F.array("x", "y"))).alias("own"))
    return sides.select("g", "task", "own.*").join(place.select("g", *key, "rep"), ["g", *key]).select("rep", "task")


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (doc_id = component_id) of every row."""
    marked = scratch(signatures(docs, shingle), "signatures")
    keys = ["n_shingles", "d1", "d2"]
    classes = scratch(marked.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")  # likewise, for many copies
    members = scratch(marked.select("doc_id", *keys).join(classes, keys, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")

    reps = members.where("doc_id = rep and n_shingles > 0").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n")).distinct()
    rows = marked.where("n_shingles > 0").join(reps.select("rep").hint("shuffle_hash"), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot")
    near = components(rows.join(shared, "key").where("rep > pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    family = scratch(near.unionByName(near.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("rep"), F.col("b").alias("g")).join(reps, "rep"), "family")
    forget(marked, near, classes)
    sets = scratch(set_table(docs, family.select(F.col("rep").alias("doc_id")), shingle), "sets")

    sizes = family.groupBy("g").agg((blocks_needed(F.count("*"), F.sum("n")) <= 1).alias("small"))
    sized = looked_up(family, sizes, ["g"])
    large = sized.where("not small").select("rep", "n", "g", size_class(percent).alias("c"))
    firsts = shipped(placed(large.withColumn("top", F.lit(False))), (F.col("x.k") == 0) | (F.col("y.k") == 0))
    compared = linked(sized.where("small").select("rep", F.xxhash64("g").alias("task")).unionByName(firsts), sets, percent)
    first = components(compared)

    labelled = large.join(first.select(F.col("a").alias("rep"), F.col("b").alias("own")), "rep", "left").withColumn("own", F.coalesce("own", "rep"))
    tops = labelled.groupBy("g", "own").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "own")).alias("most"))
    rest = looked_up(labelled, tops, ["g"]).select("rep", "n", "g", "c", (F.col("own") == F.col("most.own")).alias("top"))
    strays = shipped(placed(rest), ~(F.col("x.top") & F.col("y.top")))
    compared_again = linked(strays, sets, percent)
    found = components(first.unionByName(compared_again))
    forget(first, family, sets, compared, compared_again)

    final = members.join(found.select(F.col("a").alias("rep"), F.col("b").alias("c")), "rep", "left")
    component = F.coalesce("c", "rep")
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
