import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from llm_cases import EDGES, SF, documents, make  # noqa: F401
from cadenza.llm import quality_classifier as C
from cadenza.llm import quality_rules as R
from cadenza.llm.queries import ORACLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules_of(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            rep, n < 20 or 100 * rep > 30 * n)


def test_rules_match_brute_force_and_sql(make, spark):
    edges = [*EDGES, (12, "a b c d e f g h " * 5), (13, "x y\n x y\nx y\n# | $ <>\n\n"),
             (14, "s " * 30)]
    got = R.quality_rules(make(edges)).collect()
    want = Counter((i, *rules_of(t)) for i, t in edges)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                    r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    con = duckdb.connect()
    con.register("documents", make(edges, clash=False).toPandas())
    sql = con.execute(ORACLE["op2_quality_rules"]).df()
    assert sorted(map(str, sql[["doc_id", "n_repeat_words", "kept"]].values.tolist())) == sorted(
        map(str, make(edges).sparkSession.createDataFrame(got).toPandas()
            [["doc_id", "n_repeat_words", "kept"]].values.tolist()))


def test_hot_bad_host_is_rejected_and_small_hosts_are_shrunk(spark):
    rows = [(i, "bad " * 3 if i % 10 else " ".join(f"g{i}x{j}" for j in range(30)), "en",
             "bad", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(f"h{i}x{j}" for j in range(30)), "en", f"good{i % 8}", 1)
             for i in range(400)]
    rows += [(2000, "short", "en", "tiny", 1)]
    rows += [(2001, " ".join(f"t{j}" for j in range(30)), "en", "tiny", 1)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in R.quality_rules(docs).collect()}
    assert not any(got[i]["kept"] for i in range(400))
    assert all(got[1000 + i]["kept"] for i in range(400))
    assert got[2001]["kept"] and not got[2000]["kept"]
    kept = R.keep_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_a_host_of_junk_decides_its_documents(make, spark):
    """Texts that pass the base rules, of a host where symbols and repeated lines abound; SQL agrees."""
    rows = []
    for i in range(90):
        junk = f"## $$ %% || ** << >> && ## $$ word{i} w{i * 3} " + " ".join(f"a{i}b{j}" for j in range(20))
        lines = "\n".join([f"line of {i}"] * 4 + [" ".join(f"k{i}l{j}" for j in range(30))])
        good = " ".join(f"g{i}h{j}" for j in range(40))
        rows.append((i, junk if i % 2 else lines, "en", "junk", 0))
        rows.append((1000 + i, good, "en", "fine" if i % 3 else None, 0))
    rows += [(2000, " ".join(f"c{j}" for j in range(50)), "en", "junk", 0), (2001, "short", "en", "fine", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in R.quality_rules(docs).collect()}
    assert got[2000]["host_failed"] and not got[2000]["rule_failed"] and not got[2000]["kept"]
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(90))
    assert all(got[1000 + i]["kept"] for i in range(90)) and not got[2001]["kept"]
    kept = {r["doc_id"] for r in R.keep_documents(docs).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(R.ORACLE).df()
    names = list(want.columns)
    assert sorted(names) == sorted(R.quality_rules(docs).columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.values()))) == sorted(
        map(str, (tuple(None if x != x else x for x in r) for r in want.astype(object).itertuples(
            index=False, name=None))))


def test_prior():
    assert R.beta_prior(0, None, 0, None) == (1.0, 1.0)
    a, b = R.beta_prior(1000, 100, 10, 10.0 + 1e-9)
    assert abs(a / (a + b) - 0.1) < 1e-6


def test_empty_tables(make, spark):
    none = make([])
    assert R.quality_rules(none).count() == 0 and R.keep_documents(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert C.score_documents(none, labels).count() == 0
    some = C.score_documents(make([(1, "a b"), (2, None)]), labels).collect()
    assert {r["score"] for r in some} == {0.5}


def test_classifier_edges(make, spark):
    good = [(100 + i, " ".join(f"word{(i * 7 + j) % 91}" for j in range(50 + i))) for i in range(60)]
    bad = [(300 + i, "SPAM!! ***### " * (20 + i)) for i in range(60)]
    docs = make([*EDGES, *good, *bad])
    labels = spark.createDataFrame(
        [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (100, None, 0),
                                                                      (1, 7, 0)],
        "doc_id long, quality int, toxic int")
    got = C.score_documents(docs, labels).collect()
    assert len(got) == len(EDGES) + 120
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None
                                 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    own = {r["doc_id"]: r["predicted"] for r in got}
    assert all(own[i] == 1 for i, _ in good) and all(own[i] == 0 for i, _ in bad)
    kept = C.keep_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in own.items() if p}


def test_held_out_labels_are_never_seen(documents, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in C.score_documents(documents, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in C.score_documents(documents, flipped).collect()}
    assert np.allclose([a[i] for i in sorted(a)], [b[i] for i in sorted(a)])


def test_held_out_accuracy(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = C.score_documents(docs, labels).join(labels, "doc_id").filter("held_out")
    got = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).first()
    assert got["a"] >= 0.97


def test_scores_equal_an_independent_discriminant(documents, spark):
    """fit and score against class means and covariances, determinants and solves by numpy."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null")
    rows = C.document_features(documents).drop("_row").join(
        labels.filter(~C.held_out()).select("doc_id", "quality"), "doc_id", "left").toPandas()
    x = rows[C.FEATURES].to_numpy(float)
    y = rows["quality"].to_numpy(float)
    cov = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    n = {k: (y == k).sum() for k in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    pooled = 0.95 * pooled + 0.05 * np.diag(np.diag(pooled))
    density = {}
    for k in (0, 1):
        s = 0.9 * cov[k] + 0.1 * pooled + 1e-3 * np.eye(len(C.FEATURES))
        d = x - x[y == k].mean(axis=0)
        density[k] = (np.log((n[k] + 1) / (n[0] + n[1] + 2)) - np.linalg.slogdet(s)[1] / 2
                      - np.einsum("ni,ni->n", d, np.linalg.solve(s, d.T).T) / 2)
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    got = {r["doc_id"]: r["score"] for r in C.score_documents(documents, labels).collect()}
    assert np.allclose([got[i] for i in rows["doc_id"]], want, atol=1e-9)


def test_score_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    d = len(C.FEATURES)
    x = rng.normal(size=(50, d))
    s = np.cov(rng.normal(size=(200, d)).T) + np.eye(d)
    factor = np.linalg.cholesky(s)
    z = (x @ np.linalg.inv(factor).T)
    assert np.allclose((z ** 2).sum(axis=1), np.einsum("ni,ij,nj->n", x, np.linalg.inv(s), x))
