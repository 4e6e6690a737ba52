"""The ten queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, chat, decontaminate, html, jaccard, language, lines, neighbours, sharding, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document: token count and digests of the ids and of what they decode to."""
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of every page."""
    return html.texts(_table(spark, sf_dir, "pages"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back."""
    return chat.digests(chat.with_trap(_table(spark, sf_dir, "conversations")))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.predict(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated runs of lines."""
    return lines.dedup(_table(spark, sf_dir, "documents"), counts=True)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar documents of every document, and their components."""
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_html, op3_chat, op4_neighbours, op5_decontaminate, op6_language, op7_toxicity, op8_lines, op9_jaccard, op10_shards)}

ORACLES = {"op3_chat": chat.digests_sql(), "op5_decontaminate": decontaminate.report_sql(), "op10_shards": sharding.assign_sql()}
