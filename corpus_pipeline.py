"""A training corpus from `documents`: five stages, each over all that the one before kept.

A stage's result reads tables in the shared folder until it is written, so it
must be written before another stage begins: that deletes the tables of all
other stages of the session.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import byte_bpe
from docloom.llm.common import recorded, remove, scratch, scratch_dir, table
from docloom.llm.mixing import mixed_documents
from docloom.llm.near_dedup import near_dedup
from docloom.llm.ngram_lm import lm_quality
from docloom.llm.quality_rules import quality_rules


_tables: dict[tuple[str, str], list[str]] = defaultdict(list)


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        for key in [k for k in _tables if k[0] != app or k[1] != f.__name__]:
            for path in _tables.pop(key):
                if key[0] == app:
                    remove(spark, path)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _tables[app, f.__name__] += made
        return out

    return begun


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lm_quality(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


@stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, and all rows that are in none. Rows count by a number of their own, so doc_ids may be null or repeat."""
    taken = {c.lower() for c in docs.columns}
    number = next(c for c in ("row_number", *(f"row_number_{k}" for k in range(len(taken) + 1))) if c not in taken)
    rows = scratch(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_dedup(rows.select(F.col(number).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(number))
    return rows.join(found.hint("shuffle_hash"), number, "left_semi").select(*docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row that the mix holds."""
    from docloom.llm.queries import BYTE_BPE

    found = byte_bpe(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("near-duplicates", dedup), ("mixing", mixing), ("byte-level BPE", encoding)]

#: The stages train models, compare sets and merge bytes, which SQL cannot state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{scratch_dir(spark)}/stage{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
