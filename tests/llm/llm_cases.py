"""Shared cases and fixtures of the corpus operators' tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cadenza.llm import common  # noqa: E402

common.ship()

SF = "/root/testdata/sf0.001"
CLASH = ["kept", "shard", "score", "n_words", "ids", "_row", "t", "words", "size", "rep", "w"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [f"w{i}" for i in range(400)]


def words(*at) -> str:
    return " ".join(WORDS[i] for i in at)


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two\nthree."),
    (6, words(*range(60))), (6, words(*range(60))), (7, words(*range(60))),
    (8, words(*range(58), 90, 91)), (9, "long " + "x" * 300_000), (10, words(*range(200)) * 40),
    (None, words(*range(100, 140))), (11, "é日本😀 don't\r\n <|endoftext|> it's  'll"),
]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash."""
    def build(pairs, clash=True):
        rows = [(i, t, "en", f"src{(i or 0) % 2}" if i != 4 else None, len(t or ""))
                for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        if clash:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)])
        return df

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
