"""Corpus pipeline: filter by quality, drop repeated lines and near duplicates, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import byte_bpe, decontaminate, jaccard, line_dedup, quality
from candlewick.llm.folds import sample
from candlewick.llm.session import kept, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on the labels, does not reject."""
    labels = read(spark, sf_dir, "labels")
    return quality.stage(docs, quality.train(sample(docs, labels, "quality", quality.SAMPLE, quality.SAMPLE_BYTES)))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; those left without a line go."""
    return line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.stage(docs, read(spark, sf_dir, "benchmark"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    return byte_bpe.tokenised(docs, public_tokenizers.path(byte_bpe.RANK_FILE), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokenisation),
]

#: A trained network and BPE merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
