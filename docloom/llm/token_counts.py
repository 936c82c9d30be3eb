"""Token counts through a cache of digests.

A text's digest (SHA-256 of its normal form, nulls as empty) and the tokenizer's
version (SHA-256 of its file) are joined to stored counts. Only distinct misses
are encoded, one row for each digest, and appended to the cache; then the counts
are joined back. The normal form merges what the model cannot tell apart: it
writes a space as the mark U+2581 and reads that mark as a space, and if it
changes nothing else, marks become spaces. Otherwise texts stay as they are.

The library itself counts. Its BPE never merges over the border between a
non-space and a space where no vocabulary piece holds one, so the text is cut
there, and a bounded cache keeps the counts of words; if some piece does hold
such a border, whole texts are counted.

Null and empty texts have 0 tokens and 0 bytes. Rows that repeat are counted
alike; many copies of a text meet its count in a join that adaptive execution
can split. Texts of any length are counted whole. Only doc_id and text are read.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import groups, map_arrow, record_batch, scratch, scratch_dir

CACHED_WORDS = 500_000
MARK = "▁"
CACHE = "digest string, version string, n_tokens long"

_counters: dict[str, WordCounter] = {}


class WordCounter:
    """Counts of a sentencepiece model, without begin, end or added special tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.plain = self.model.normalize(f"a  b\n{MARK} ²ﬁ ") == f"{MARK}a{MARK}{MARK}b\n{MARK}{MARK}²ﬁ{MARK}"
        self.cuts = self.plain and not any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:]))
        self.words: dict[str, int] = {}

    @staticmethod
    def at(path: str) -> WordCounter:
        if path not in _counters:
            _counters[path] = WordCounter(path)
        return _counters[path]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self.whole(texts)
        cut = []
        for text in texts:
            text = text.replace(MARK, " ") if MARK in text else text
            if not text:
                cut.append([])
            elif text[0] != " " and text[-1] != " " and "  " not in text:
                cut.append(text.split(" "))
            else:
                cut.append(self.runs(text))
        wanted = {w for words in cut for w in words}
        if missing := list(wanted - self.words.keys()):
            if len(self.words) + len(missing) > CACHED_WORDS:
                self.words.clear()
                missing = list(wanted)
            self.words.update(zip(missing, self.whole(missing), strict=True))
        known = self.words.__getitem__
        return [sum(map(known, words)) for words in cut]

    @staticmethod
    def runs(text: str) -> list[str]:
        """Each word with the spaces before it but one, which the model adds itself; trailing spaces alone."""
        out, lead = [], ""
        for word in text.split(" "):
            if word:
                out.append(lead + word)
                lead = ""
            else:
                lead += " "
        return out + ([lead] if lead else [])


def content(docs: DataFrame, plain: bool) -> DataFrame:
    """doc_id, text (not null) and digest of its normal form."""
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = F.replace(text, F.lit(MARK), F.lit(" ")) if plain else text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(normal, 256).alias("digest"))


def token_counts(docs: DataFrame, path: str, cache_dir: str | None = None) -> DataFrame:
    """doc_id, digest, n_bytes and n_tokens of every row. cache_dir: a table of digest, version, n_tokens, which is read and appended to; without one, a new table in the shared folder."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()[:16]
    fresh = cache_dir is None
    cache_dir = cache_dir or f"{scratch_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_dir)
    cache = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("version") == version).select("digest", "n_tokens")

    keyed = content(docs, WordCounter.at(path).plain)
    misses = keyed.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id")).join(cache, "digest", "left_anti")
    texts = keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(misses.hint("shuffle_hash"), ["doc_id", "digest"], "left_semi").select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects, no cycles
        counter = WordCounter.at(path)
        for part, some in groups(batches):
            yield record_batch({"digest": part.column(0), "version": [version] * len(some), "n_tokens": counter.count(some)}, {"digest": pa.string(), "version": pa.string(), "n_tokens": pa.int64()})

    map_arrow(texts, run, CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(cache_dir)
    stored = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("version") == version).select("digest", "n_tokens")
    if not fresh:  # appends of runs at the same time may repeat; a table of its own lets the join be split
        stored = scratch(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    sized = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(stored.hint("merge"), "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
