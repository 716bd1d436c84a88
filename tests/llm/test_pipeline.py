"""Each stage of the pipeline against a brute-force version of it, on its own input."""

from collections import Counter

import pytest
from llm_cases import SF, WORDS, documents, make  # noqa: F401
from pyspark.sql import functions as F
from test_near_dup import brute_force
from test_packing import check as check_packing
from test_quality import rules_of

import corpus_pipeline as P
from cadenza.llm import quality_classifier, quality_rules

SF01 = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()),
                  key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output at sf0.01, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{SF01}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF01).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates",
                                        "packing"]
    for _, given, kept in stages[:-1]:
        assert kept.columns == given.columns and 0 < kept.count() < given.count()
        assert kept.exceptAll(given).count() == 0  # rows pass unchanged


def test_classifier_stage(spark, stages):
    _, given, kept = stages[0]
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    scores = quality_classifier.score_documents(given, labels)
    want = [r["doc_id"] for r in scores.filter("predicted = 1").collect()]
    assert Counter(i for i, _ in rows_of(kept)) == Counter(want)
    marks = scores.join(labels, "doc_id").filter("held_out")
    clean = marks.filter("quality = 1")
    assert clean.filter("predicted = 1").count() >= 0.98 * clean.count()
    assert marks.filter("quality = 0 and predicted = 0").count() >= 0.9 * marks.filter(
        "quality = 0").count()


def test_rules_stage(stages):
    _, given, kept = stages[1]
    want = [(i, t) for i, t in rows_of(given) if not rules_of(t)[-1]]
    hosts = Counter(r["source"] for r in given.collect())
    bad = Counter(r["source"] for r in given.collect() if rules_of(r["text"])[-1])
    assert max(bad[h] / n for h, n in hosts.items()) < quality_rules.MAX_HOST_RATE
    assert rows_of(kept) == want


def test_dedup_stage(stages):
    _, given, kept = stages[2]
    root, _ = brute_force(rows_of(given), P.PIPELINE_PERCENT)
    assert [i for i, _ in rows_of(kept)] == sorted({i for i, r in root.items() if i == r}, key=str)


def test_packing_stage(stages):
    _, given, packed = stages[3]
    check_packing(packed.collect(), rows_of(given), given.rdd.getNumPartitions())


def test_run_gives_the_stages_rows(spark, stages):
    got = P.run(spark, SF01)
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = got.groupBy("doc_id").agg(F.sum("length").alias("n"))
    want = stages[3][2].groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert set(keys) <= set(got.columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.collect()))


def test_empty_and_edge_documents(spark, make):  # noqa: F811
    good = [(i, " ".join(f"{w}x{i}" for w in WORDS[i % 50:i % 50 + 60])) for i in range(40)]
    docs = make([*good, (900, good[0][1]), (901, None), (902, ""), (903, "short")])
    for table in (docs, make([])):
        df = table
        for _, stage in P.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        assert {r["doc_id"] for r in df.collect()} <= {i for i, _ in good}
        P.STAGES[-1][1](spark, df, SF).collect()
