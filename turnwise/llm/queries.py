"""Registered queries of this package: ``opN_<name>(spark, sf_dir)`` with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fuzzy_lines, katz, language, nearest, orc_ids, packing, prefix_table, prefix_trie, quality, ranked_search, simhash, token_counts
from .common import crc_mod, documents, reachable
from .pieces import vocabulary
from .sql import ORACLE

END_ID = 2


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("th")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 4) == 2
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out, held_out)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, radius=3)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(documents(spark, sf_dir), shingles=True).select("doc_id", "n_lines", "n_removed", "text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), END_ID, capacity=1024)


def op9_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_ids.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), END_ID)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir), divisor=7, fold=2)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def op12_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_table.digests(prefix_table.encode_decode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_language_id, op3_nearest, op4_quality, op5_simhash, op6_fuzzy_lines,
                            op7_decontaminate, op8_packing, op9_orc_ids, op10_katz, op11_ranked_search, op12_prefix_table, op13_prefix_trie)}

__all__ = ["ORACLE", "QUERIES"]
