"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

Every stage but the last gives back the columns of documents, whatever other columns there are and however they are
called. Defined cases, by stage: documents without a word go at the quality stage (score 0); without labels, or with one
class alone, the classifier keeps all that have a word. Null and repeated ids are ids like any other; rows
with equal doc_id and text are one document and leave one row after near-dedup. Nulls in other columns are kept. Very
long texts are read whole. An empty table, or an empty benchmark, gives no rows, or drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierlake.llm import op1_best_fit_packing, op6_minhash_near_dedup, op7_benchmark_decontamination, op9_quality_classifier, op10_line_dedup
from tierlake.llm.common import cleanup, drop, settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    return op9_quality_classifier.filter_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that an earlier line makes superfluous."""
    return op10_line_dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return op6_minhash_near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of a test item."""
    return op7_benchmark_decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return op1_best_fit_packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Trained scores, random projections, alignments and a tokenizer are not SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one's documents stand."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with cleanup(spark):
            docs = settle(stage(spark, docs, sf_dir), keep=True)
        for old in written:
            drop(old)
        written = [docs]
    return docs
