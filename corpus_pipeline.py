"""Corpus pipeline: classifier, rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import common, near_dup, packing, quality_classifier, quality_rules
from cadenza.llm.common import staged, table
from cadenza.session import Stages

common.ship()

SCRATCH = Stages()   # tables that a stage's result still reads; gone when the next stage begins

PIPELINE_PERCENT = 80  # similarity of five-word shingles from which documents count as copies


def stage_of(function):
    """A stage that first deletes what earlier stages have left, but for what ``docs`` reads."""
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        SCRATCH.release(docs)
        with SCRATCH:
            return function(spark, docs, sf_dir)

    return run


@stage_of
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_documents(docs, table(spark, sf_dir, "labels"))


@stage_of
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality_rules.keep_documents(docs)


@stage_of
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.keep_documents(docs, PIPELINE_PERCENT)


@stage_of
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of tokens: one row per piece."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", classify), ("quality_rules", rules),
          ("near_duplicates", dedup), ("packing", pack)]

#: No SQL: the classifier's features and the packing's tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        with SCRATCH:
            docs = staged(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)
