"""Registered queries: each operator over its whole table, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lossledger.llm import oracle
from lossledger.llm.common import table
from lossledger.llm.decontaminate import contamination
from lossledger.llm.jaccard import jaccard_classes
from lossledger.llm.mixing import mix
from lossledger.llm.neighbours import nearest
from lossledger.llm.packing import pack, token_pieces
from lossledger.llm.perspectives import perspectives
from lossledger.llm.phrases import collocations
from lossledger.llm.secrets import find_secrets
from lossledger.llm.sharding import shard_documents
from lossledger.llm.substrings import deduplicated
from lossledger.llm.toxicity import toxicity
from lossledger.llm.trie import prefix_trie
from lossledger.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_adaptive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_adaptive_neighbours, op2_substring_dedup, op3_secret_scan, op4_toxicity, op5_decontamination,
    op6_sharding, op7_vector_packing, op8_jaccard_join, op9_url_filter, op10_perspectives, op11_source_mixing,
    op12_collocations, op13_prefix_trie)}

SQL: dict[str, str] = {
    "op2_substring_dedup": oracle.SUBSTRINGS,
    "op5_decontamination": oracle.CONTAMINATION,
    "op8_jaccard_join": oracle.JACCARD,
    "op9_url_filter": oracle.URLS,
    "op10_perspectives": oracle.PERSPECTIVES,
    "op11_source_mixing": oracle.MIXING,
    "op12_collocations": oracle.COLLOCATIONS,
    "op13_prefix_trie": oracle.TRIE,
}
