"""The subpackage's registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetnet.llm import language, licences, mixing, passages, pieces, quality, rules, sharding, simhash, syncmers
from fleetnet.llm.common import table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(language.corpus_items(table(spark, sf_dir, "pages"), docs), language.train(docs))
    return found.select(F.when(~F.col("is_page"), F.col("id")).alias("doc_id"), F.when(F.col("is_page"), F.col("id")).alias("page_id"), "host", "declared", "text_lang", "lang", "posterior")


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op6_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removed(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",")
    return found.select("doc_id", names.alias("licences"), F.array_join("sentences", ",").alias("sentences"), F.size("matches").alias("n_matches"), "matches")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
        "op2_source_mixing": op2_source_mixing,
        "op3_language_fusion": op3_language_fusion,
        "op4_quality_knn": op4_quality_knn,
        "op5_sampled_pieces": op5_sampled_pieces,
        "op6_suffix_passages": op6_suffix_passages,
        "op7_quality_rules": op7_quality_rules,
        "op8_simhash_groups": op8_simhash_groups,
        "op9_hilbert_shards": op9_hilbert_shards,
        "op10_licence_scan": op10_licence_scan,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query; the others are held against brute force in tests/llm."""
    return {}
