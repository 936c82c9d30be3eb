"""Blocks to windows: tables split with their header, prose packed by sentence similarity."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.functions.arrow import small_batches, trim
from docloom.models import Embedder, SentenceSplitter

MAX_CHARS, MIN_CHARS, MIN_PIECE, CEILING = 1200, 80, 200, 0.75
SPLIT_FROM, SHORT, PERCENT = 300, 500, 0.3
DIMS = 64


def table_pieces(text: Column, limit: int = MAX_CHARS) -> Column:
    """A table's rows in pieces; a piece ends after it exceeds the limit, and the next starts with the first two rows again. A fold over the rows whose state decides where it goes on, in time linear in the rows."""

    def one(table: str | None) -> list[str]:
        rows = [r for r in (table or "").split("\n") if r.strip()]
        head, out, held, size = rows[:2], [], [], 0
        start = size = len("\n".join(head))
        for row in rows[2:]:
            held.append(row)
            size += len(row) + 1
            if size > limit:
                out.append("\n".join([*head, *held]))
                held, size = [], start
        return out + ["\n".join([*head, *held])] if held or not out else out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tables in parts:
            yield tables.map(one)
        trim()

    small_batches()
    return cut(text)


def sentences(text: Column, splitter: SentenceSplitter | None = None) -> Column:
    """The sentences of a text, by a splitter, or by a stand-in for a trained one: cut after . ! or ? and white space."""
    if splitter is None:
        return F.filter(F.split(tx.strip(text), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")

    small_batches()

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: splitter.split(t or ""))

    return cut(text)


def embedded_similarities(found: Column, embedder: Embedder) -> Column:
    """Cosine of each sentence and the next, by an embedder, which gets the sentences of a batch of texts at once."""

    small_batches()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def similar(texts: pd.Series) -> pd.Series:
        every = [s for sents in texts for s in sents]
        if not every:
            return texts.map(lambda _: np.empty(0))
        v = np.asarray(embedder.encode(every), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        near, ends = (v[:-1] * v[1:]).sum(1), np.cumsum([len(s) for s in texts])
        return pd.Series([near[end - len(s) : max(end - 1, end - len(s))] for s, end in zip(texts, ends, strict=True)])

    return similar(found)


BREAK = "\0"


def adjacent_similarities(found: Column) -> Column:
    """Cosine of each sentence and the next. Stand-in embedding: hashed bags of words, kept as whole numbers, so that sums are exact in any order."""
    small_batches()
    return hashed_similarities(found)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_similarities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    gone = str.maketrans("", "", string.punctuation)
    known = tx.Buckets(DIMS)

    def one(sents: np.ndarray) -> np.ndarray:
        n = len(sents)
        if n < 2:
            return np.empty(0)
        tokens = f"\n{BREAK}\n".join([s.replace(BREAK, " ") if BREAK in s else s for s in sents]).lower().translate(gone).split()
        of = np.array([known[t] if len(t) > 1 else -1 if t == BREAK else -2 for t in tokens], np.int64)
        owner = np.cumsum(of == -1)[of >= 0]
        bags = np.bincount(owner * DIMS + of[of >= 0], minlength=n * DIMS).reshape(n, DIMS)
        norms = np.sqrt((bags * bags).sum(1).astype(np.float64))
        dots = (bags[:-1] * bags[1:]).sum(1).astype(np.float64)
        both = norms[:-1] * norms[1:]
        return np.where(both > 0, dots / np.where(both > 0, both, 1.0), 0.0)

    for found in parts:
        yield found.map(one)
    trim()


def threshold(sims: Column) -> Column:
    """The 30th percentile with linear interpolation, bit for bit as a lerp from the nearer end, 0.75 at most."""
    y = F.array_sort(sims)
    v = (F.size(y) - 1) * F.lit(PERCENT)
    lo = F.floor(v).cast("int")
    t = v - lo
    a, b = F.get(y, lo), F.get(y, F.least(lo + 1, F.size(y) - 1))
    return F.least(F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t), F.lit(CEILING))


def packed(sents: Column, sims: Column, limit: Column, overlap: int = 0, merge: bool = False) -> Column:
    """Sentences packed in order: a piece ends where similarity falls below the limit past 300 characters, or where MAX_CHARS would be passed; the next begins with its last `overlap` sentences. Linear in the sentences. merge: as merged(), by the same worker."""

    def one(found: np.ndarray, near: np.ndarray, least: float) -> list[str]:
        if not len(found):
            return []
        out, held, n = [], [found[0]], len(found[0])
        for sent, sim in zip(found[1:], near, strict=False):
            if sim < least and n > SPLIT_FROM or n + len(sent) > MAX_CHARS:
                out.append(" ".join(held))
                held = [*(held[-overlap:] if overlap else []), sent]
                n = sum(len(s) + 1 for s in held)
            else:
                held.append(sent)
                n += len(sent) + 1
        return [*out, " ".join(held)]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in parts:
            made = [one(*x) for x in zip(*columns, strict=True)]
            yield pd.Series([joined(x) for x in made] if merge else made)
        trim()

    small_batches()
    return pack(sents, sims, limit)


def joined(found: Iterable[str]) -> list[str]:
    """Pieces under MIN_PIECE characters join the piece before them."""
    groups: list[list[str]] = []
    for piece in found:
        if groups and len(piece) < MIN_PIECE:
            groups[-1].append(piece)
        else:
            groups.append([piece])
    return [" ".join(g) for g in groups]


def merged(pieces: Column) -> Column:
    """joined() of a column."""
    small_batches()

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def merge(rows: pd.Series) -> pd.Series:
        return rows.map(joined)

    return merge(pieces)


def prose_pieces(rows: DataFrame, splitter: SentenceSplitter | None = None, embedder: Embedder | None = None, overlap: int = 0) -> DataFrame:
    """rows(text, ...) with `pieces`, computed stepwise so that each array is made once. Without models, stand-ins split and compare sentences."""
    known = rows.withColumn("sents", sentences(F.col("text"), splitter))
    known = known.withColumn("many", (F.size("sents") > 1) & (F.length("text") > SHORT)).withColumn("asked", F.when(F.col("many"), F.col("sents")).otherwise(F.array().cast("array<string>")))
    cut = known.withColumn("sims", embedded_similarities(F.col("asked"), embedder) if embedder else adjacent_similarities(F.col("asked"))).withColumn("limit", threshold(F.col("sims")))
    made = F.when(F.col("many"), packed(F.col("asked"), F.col("sims"), F.col("limit"), overlap, merge=True)).otherwise(F.array("text"))
    return cut.withColumn("pieces", made).withColumn("pieces", F.filter("pieces", lambda p: F.length(p) >= MIN_CHARS)).drop("sents", "asked", "many", "sims", "limit")


def windows(blocks: DataFrame, splitter: SentenceSplitter | None = None, embedder: Embedder | None = None, overlap: int = 0) -> DataFrame:
    """doc_id, block, part, piece, heading_stack, text and the flags that are known (null: to be detected)."""
    from docloom.operators.blocks import sub_blocks

    plain = (F.length("text") <= MAX_CHARS) & ~tx.has_table(F.col("text")) & ~F.col("text").contains("```")
    flag = lambda c: F.lit(c).cast("boolean")
    fast = blocks.where(plain).where(F.length("text") >= MIN_CHARS).select("doc_id", "block", F.lit(0).cast("long").alias("part"), F.lit(0).alias("piece"), "heading_stack", "text", flag(None).alias("w_table"), flag(None).alias("w_code"))
    parts = sub_blocks(blocks.where(~plain)).where(F.length("text") >= MIN_CHARS)
    code = parts.where("kind = 'code'").select("doc_id", "block", "part", F.lit(0).alias("piece"), "heading_stack", "text", flag(None).alias("w_table"), flag(True).alias("w_code"))
    tables = parts.where("kind = 'table'").select("doc_id", "block", "part", F.posexplode(table_pieces(F.col("text"))).alias("piece", "text"), "heading_stack").where(F.length("text") >= MIN_CHARS)
    tables = tables.select("doc_id", "block", "part", "piece", "heading_stack", "text", flag(True).alias("w_table"), flag(None).alias("w_code"))
    prose = prose_pieces(parts.where("kind = 'text'"), splitter, embedder, overlap).select("doc_id", "block", "part", F.posexplode("pieces").alias("piece", "text"), "heading_stack")
    prose = prose.select("doc_id", "block", "part", "piece", "heading_stack", "text", flag(None).alias("w_table"), flag(None).alias("w_code"))
    return fast.unionByName(code).unionByName(tables).unionByName(prose)
