"""Queries that apply each operator, with production parameters, to a whole table, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import byte_bpe_digests
from docloom.llm.common import table
from docloom.llm.html_extract import extract_text
from docloom.llm.media import audio_digests
from docloom.llm.mixing import mix
from docloom.llm.near_dedup import near_dedup
from docloom.llm.ngram_lm import lm_quality
from docloom.llm.oracles import SQL
from docloom.llm.quality_rules import quality_rules
from docloom.llm.sharding import shards
from docloom.llm.token_counts import token_counts
from docloom.llm.url_filter import url_filter

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
LONG_TOKENS = 4096


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of a document's words as text, shard:words."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.withColumn("shards", F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s["shard"], s["words"])), ","))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return found.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {LONG_TOKENS} AS over_limit")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_lm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def queries() -> dict:
    return {f.__name__: f for f in (op1_shards, op2_mix, op3_token_counts, op4_quality_rules, op5_media, op6_byte_bpe, op7_main_text, op8_lm_quality, op9_url_filter, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
