"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from cadenza.llm import (
    bpe,
    chat,
    collocations,
    common,
    hard_negatives,
    hilbert_knn,
    licenses,
    near_dup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    token_counts,
    winnowing,
)
from cadenza.llm.common import table

common.ship()


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_chat_windows(spark, sf_dir):
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(turns))


def op5_nearest_vectors(spark, sf_dir):
    return hilbert_knn.nearest(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_documents(table(spark, sf_dir, "documents"), short=licenses.SHORT)


def op11_benchmark_decontamination(spark, sf_dir):
    return winnowing.scan_documents(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_quality_rules, op3_sharding, op4_chat_windows,
    op5_nearest_vectors, op6_bpe, op7_token_counts, op8_near_duplicates, op9_packing,
    op10_license_scan, op11_benchmark_decontamination, op12_hard_negatives,
    op13_phrase_collocations)}

ORACLE = {"op2_quality_rules": quality_rules.ORACLE, "op4_chat_windows": chat.ORACLE,
          "op11_benchmark_decontamination": winnowing.ORACLE,
          "op12_hard_negatives": hard_negatives.ORACLE,
          "op13_phrase_collocations": collocations.ORACLE}
