"""A corpus pipeline of five stages over the table documents; each stage's rows are the next one's documents.

Quality classifier: rejected documents go. Line dedup: duplicate lines go, and documents that keep no line of their own.
N-gram Jaccard join: one document of each group of near duplicates stays. Decontamination: documents that hold enough of
the benchmark go. Mixing: each document left gets the rate at which it is to be drawn.

Defined results: rows are judged one by one, by id and text together, so null and repeated ids are no exception; of rows
equal in both one stays; null texts and texts without words stay, with 0 tokens; without labels nothing is rejected and all
domains are as likely; an empty table gives no rows. Extra columns are carried along, whatever their names, up to the last
stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontaminate, line_dedup, mixing, ngram_join, quality_lm
from llm.common import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_lm.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_duplicate_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8."""
    return ngram_join.one_of_each(docs, 5, 80, 100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.rates(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_rates),
]
#: Signatures, shingles and iterated fits have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
