"""One query per operator, over its whole table with production parameters, and SQL where it can be said in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import decontamination, hard_negatives, katz_model, license_scan, line_dedup, ngram_join, pivot_index, quality_rules, sentencepiece_codec, sharding, source_mixing, spelling_variants, suffix_dedup
from meshwork.llm.staging import table


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar(table(spark, folder, "documents"), size=4, num=85, den=100)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "rejected_by")


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.byte_shards(table(spark, folder, "documents"), 16)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, folder, "documents"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return source_mixing.decisions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scanned(table(spark, folder, "documents"), license_scan.known_licenses(spark))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, folder, "documents")).select("doc_id", "line_no", "kind")


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    return katz_model.scored(table(spark, folder, "documents"))


def op10_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_index.near_vectors(table(spark, folder, "embeddings"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantized(table(spark, folder, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(table(spark, folder, "documents"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("item_ids", "spans")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_quality_rules, op3_sharding, op4_suffix_dedup, op5_source_mixing, op6_license_scans, op7_line_dedup, op8_sentencepiece, op9_katz_scores, op10_pivot_index, op11_hard_negatives, op12_spelling_variants, op13_decontamination)}
ORACLES = {"op1_ngram_jaccard": ngram_join.ORACLE, "op6_license_scans": license_scan.oracle(), "op7_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_decontamination": decontamination.ORACLE}
