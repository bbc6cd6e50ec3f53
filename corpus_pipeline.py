"""A training-corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, SentencePiece encoding.

Each stage takes (spark, docs, folder) and returns a DataFrame; ``run`` writes each result as Parquet in the cluster's
shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import line_dedup, ngram_join, quality_rules, sentencepiece_codec, source_mixing
from meshwork.llm.staging import staged, table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules keep, judged on whole texts; null and empty texts go."""
    return quality_rules.kept_documents(docs, table(spark, folder, "labels"))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that match an earlier line; those that lose all their words go, as copies of earlier ones."""
    return line_dedup.without_repeated_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, size=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their rates say, so that domains have their target weights in tokens."""
    return source_mixing.mixed(docs, table(spark, folder, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, the number of tokens, the ids as decimal text, the decoded text, and digests of both."""
    return sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("mixing", mixing), ("sentencepiece", encoding)]
#: Stages choose thresholds and rates iteratively, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
