"""kNN: batch equals single, both indexes equal brute force, bounds hold, invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import albums, nearest
from cadenza.operators.knn import knn_batch, knn_postings, knn_single, posting_scores, postings_of, terms_of
from cadenza.operators.recommend import build_artist_model, recommend_artists, recommend_artists_batch
from cadenza.plans.registry import catalog
from cadenza.session import stage

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark, SF_SMALL)


@pytest.fixture(scope="module")
def amodel(cat):
    return build_artist_model(cat, staging="checkpoint")


def test_batch_equals_single(spark, cat, amodel):
    reqs = [(1, [1, 2, 4], [33], 5), (2, [10], [], 7), (3, [3, 12], [5, 6], 3)]
    rdf = spark.createDataFrame(reqs, "request_id long, seeds array<long>, blacklist array<long>, top_n int")
    batch = recommend_artists_batch(amodel, rdf).collect()
    for rid, seeds, bl, k in reqs:
        single = recommend_artists(amodel, seeds, k, bl).orderBy("rank").collect()
        b = sorted((r["rank"], r["artist_id"]) for r in batch if r["request_id"] == rid)
        assert b == [(r["rank"], r["artist_id"]) for r in single]
        for r in batch:
            if r["request_id"] == rid:
                assert r["artist_id"] not in seeds + bl          # no seed / blacklist leak


def test_posting_lists_equal_a_scan_of_every_candidate(spark):
    rng = np.random.default_rng(11)
    rows, ok = [], {}
    for e in range(400):
        for t in rng.choice(30, rng.integers(1, 5), replace=False):
            rows.append((e, f"t{t}", float(rng.integers(1, 4))))
        rows.append((e, "all", 0.5)) if e % 3 == 0 else None      # a third of the entities hold one token
        ok[e] = e % 7 != 0
    rows += [(400 + e, "only", 1.0) for e in range(6)]            # ties, and a list of six
    vectors = spark.createDataFrame(rows, "artist_id long, token string, w double")
    terms = stage(terms_of(vectors).unionByName(spark.createDataFrame(
        [(900, [], 0.0)], "artist_id long, terms array<struct<token:string,w:double>>, norm double"))
        .withColumn("recommendable", F.col("artist_id") % 7 != 0))
    lists = stage(postings_of(terms), by=["bucket"])
    eligible = F.col("recommendable")
    for centroid, k, exclude, where in [
            ({"t1": 0.7, "t2": 0.2, "all": 0.4}, 10, {3, 9}, eligible),
            ({"t1": 0.7}, 200, {2}, None),                        # the list is shorter than k: the tail by id
            ({"only": 1.0}, 9, {401}, eligible),                  # ties in the list, then the tail
            ({"t3": 1e-12, "only": 1.0}, 6, (), None),            # nearer than 1 by less than the rank keeps
            ({"t3": 1e-12, "only": 1.0}, 40, (), None),
            ({"unseen": 1.0}, 4, {0, 1}, eligible), ({}, 4, (), None),
            ({"only": 1.0}, 1000, (), None)]:
        want = knn_single(terms, centroid, k, exclude=exclude, where=where).orderBy("rank").collect()
        got = knn_postings(lists, terms, centroid, k, exclude=exclude, where=where)
        assert [(r, i) for r, i, _ in got] == [(r["rank"], r["artist_id"]) for r in want]
        assert np.allclose([d for *_, d in got], [r["distance"] for r in want], atol=1e-12)
    assert knn_postings(lists.limit(0), terms.limit(0), {"t1": 1.0}, 3) == []
    assert stage(postings_of(terms.limit(0)), by=["bucket"]).count() == 0


def test_a_request_opens_the_folders_of_its_tokens(amodel):
    token = amodel.vocab.orderBy("df", "token").first()["token"]
    scored = posting_scores(amodel.postings, {token: 1.0})
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert f"EqualTo(token,{token})" in plan or f"In(token, [{token}])" in plan
    assert {r[0] for r in scored.select("artist_id").collect()} == {
        r[0] for r in amodel.vectors.where(F.col("token") == token).select("artist_id").collect()}
    folders = {f.rsplit("/", 2)[1] for f in amodel.postings.inputFiles()}
    assert 1 < len(folders) and all(f.startswith("bucket=") for f in folders)


def _brute(vecs, k):
    ids = sorted(vecs)
    keys = sorted({t for v in vecs.values() for t in v})
    col = {t: i for i, t in enumerate(keys)}
    M = np.zeros((len(ids), len(keys)))
    for i, e in enumerate(ids):
        for t, w in vecs[e].items():
            M[i, col[t]] = w
    n = np.linalg.norm(M, axis=1)
    D = 1 - (M @ M.T) / np.outer(n, n)
    out = {}
    for i, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (round(D[i, j], 12), ids[j]))[:k]
        out[q] = [ids[j] for j in order]
    return out


def _got(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["cand_id"]))
    for v in got.values():
        assert sorted(x for x, _ in v) == list(range(1, len(v) + 1))
    return {k: [x for _, x in sorted(v)] for k, v in got.items()}


def _asked(vectors, n):
    return vectors.select(F.col("id").alias("query_id"), F.col("token").alias("key"), "w",
                          F.lit(n).alias("top_n"))


def test_album_indexes_match_brute_force(spark, cat, monkeypatch):
    """The box index, fine and coarse and in several home cells, and the token index in parts."""
    m = albums.build_album_model(cat, backfill=False, language=False, types=False)
    vecs = {}
    for r in m.vectors.collect():
        vecs.setdefault(r["id"], {})[r["token"]] = r["w"]
    expect = _brute(vecs, 4)
    q = _asked(m.vectors, 4)
    got = _got(nearest.search(m.index(), q, digits=12))
    assert got == expect
    monkeypatch.setattr(nearest, "HOME", 20)
    c = m.vectors.select(F.col("id").alias("cand_id"), F.col("token").alias("key"), "w")
    for limit, block in ((20_000, 50), (6, 30)):
        monkeypatch.setattr(nearest, "MAX_BOXES", limit)
        index = nearest.box_index(c, "4", ["2", "3", "0", "1"], [["2", "3"], ["2"]], block=block)
        assert len(index.boxes) <= limit and (index.boxes["salts"] > 1).any()
        assert _got(nearest.search(index, q, digits=12)) == expect
    assert _got(knn_batch(q, c, block=97, digits=12)) == expect


def test_bounds_leave_cells_out(spark):
    """Clustered vectors: a query meets a small share of the rows."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        g = i % 30
        rows += [(i, f"g{g}", 5.0), (i, f"h{g}", 3.0), (i, "all", 1.0)]
        rows += [(i, f"x{int(rng.integers(8))}", 0.5)]
    df = spark.createDataFrame(rows, "id long, token string, w double") \
        .groupBy("id", "token").agg(F.sum("w").alias("w"))
    c = df.select(F.col("id").alias("cand_id"), F.col("token").alias("key"), "w")
    index = nearest.token_index(c, block=64)
    q = nearest.packed(_asked(df, 5).withColumnRenamed("token", "key"), "query_id",
                       [F.max("top_n").alias("top_n")])
    worst = q.withColumn("worst", F.lit(0.05 * 1e9))
    cells = index.cells.groupBy("cell").agg(F.countDistinct("cv").alias("n"))
    met = nearest._token_visits(index, worst, 9).join(cells, "cell").groupBy("query_id").agg(
        F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
    assert met < 0.2 * 600
    vecs = {}
    for r in df.collect():
        vecs.setdefault(r["id"], {})[r["token"]] = r["w"]
    assert _got(nearest.search(index, _asked(df, 5))) == _brute(vecs, 5)


def test_box_bounds_hold():
    import pandas as pd
    rng = np.random.default_rng(5)
    y = rng.integers(0, 6, (200, 3)) / rng.integers(100, 103, (200, 1))
    x = rng.integers(0, 6, (50, 3)) / rng.integers(100, 103, (50, 1))
    box = pd.DataFrame({f"x{i}_{e}": [f(y[k::10, i]) for k in range(10)]
                        for i in range(3) for e, f in (("lo", np.min), ("hi", np.max))})
    box["bounded"] = [True] * 9 + [False]
    low = nearest._box_bounds(box, x, np.arange(50) != 0)
    full = lambda v: np.hstack([np.ones((len(v), 1)), v])
    a, b = full(x), full(y)
    d = 1 - (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    for k in range(10):
        assert (low[:, k] <= d[:, k::10].min(axis=1) + 1e-15).all()
    assert (low[1:, :9] > 0).any() and not low[0].any() and not low[:, 9].any()


def test_large_classes_and_queries_without_neighbours(spark, monkeypatch):
    """A class of a third of all rows under long exclusions; vectors that share no token."""
    monkeypatch.setattr(nearest, "KEEP", 4)
    monkeypatch.setattr(nearest, "SALTS", 2)
    vecs = {i: {"rock": 2.0} if i % 3 == 0 else {f"t{i % 7}": 1.0, "pop": 0.5} for i in range(90)}
    vecs[200], vecs[201] = {"alone": 1.0}, {"zero": 0.0}
    base = spark.createDataFrame([(i, t, w) for i, v in vecs.items() for t, w in v.items()],
                                 "id long, token string, w double")
    gone = {0: list(range(0, 60, 3)), 3: [3], 200: [200, 0, 1, 2], 201: [], 4: [4, 11, 18]}
    ex = spark.createDataFrame([(k, x) for k, v in gone.items() for x in v],
                               "query_id long, cand_id long")
    q = _asked(base.where(F.col("id").isin(list(gone))), 6)
    c = base.select(F.col("id").alias("cand_id"), F.col("token").alias("key"), "w")
    ids = sorted(vecs)
    keys = sorted({t for v in vecs.values() for t in v})
    mat = np.array([[vecs[i].get(t, 0.0) for t in keys] for i in ids])
    n = np.linalg.norm(mat, axis=1)
    with np.errstate(invalid="ignore"):
        d = np.nan_to_num(1 - (mat @ mat.T) / np.outer(n, n), nan=1.0)
    want = {k: [x for _, x in sorted((round(d[ids.index(k), j], 9), i) for j, i in enumerate(ids)
                                     if i not in v)[:6]] for k, v in gone.items()}
    assert _got(knn_batch(q, c, exclusions=ex)) == want
    assert _got(knn_batch(q.limit(0), c)) == {} and _got(knn_batch(q, c.limit(0))) == {}
    with pytest.raises(ValueError):
        nearest.search(nearest.token_index(c), q, filters=ex)


def test_invariants(spark, cat, amodel):
    from cadenza.plans.artist_queries import every_artist_requests
    r = recommend_artists_batch(amodel, every_artist_requests(amodel), filter_recommendable=False)
    rows = r.collect()
    assert all(0 <= x["distance"] <= 2 + 1e-12 for x in rows)
    assert all(x["request_id"] != x["artist_id"] for x in rows)
    per = {}
    for x in rows:
        per.setdefault(x["request_id"], []).append(x)
    for lst in per.values():
        lst.sort(key=lambda x: x["rank"])
        assert [x["rank"] for x in lst] == list(range(1, len(lst) + 1))
        d = [round(x["distance"], 9) for x in lst]
        assert d == sorted(d)
        assert len({x["artist_id"] for x in lst}) == len(lst)


def test_cell_chunking_is_exact(monkeypatch):
    import pandas as pd
    rng = np.random.default_rng(7)

    def rows(n, width, name):
        return pd.DataFrame([{name: i, "keys": (k := np.sort(rng.choice(30, width, replace=False))),
                              "ws": (w := rng.integers(1, 4, width).astype(float)),
                              "norm": float(np.sqrt((w * w).sum()))} for i in range(n)])

    q, c = rows(40, 4, "query_id"), rows(50, 3, "cv")
    q["top_n"], q["worst"] = 3, 4e9
    q["excluded"] = [np.array([i, i + 1]) for i in range(40)]
    q["fkeys"] = [np.array([5]) if i == 0 else np.array([], int) for i in range(40)]
    c["ids"] = [np.array([i, i + 100]) for i in range(50)]
    c["n_ids"] = 2
    whole = nearest._score(q, c, 9)
    monkeypatch.setattr(nearest, "QUERY_CHUNK", 7)
    monkeypatch.setattr(nearest, "KEY_CHUNK", 5)
    parts = nearest._score(q, c, 9)
    key = ["query_id", "rk", "cand_id"]
    pd.testing.assert_frame_equal(whole[key].sort_values(key).reset_index(drop=True),
                                  parts[key].sort_values(key).reset_index(drop=True))
    assert (whole.groupby("query_id").size() <= 3).all() and whole["query_id"].nunique() == 40
    held = {i for i, k in enumerate(c["keys"]) if 5 in k}
    assert set(whole[whole.query_id == 0].cv) <= held
    assert not ((whole.cand_id == whole.query_id) | (whole.cand_id == whole.query_id + 1)).any()


@pytest.mark.parametrize("kind", ["int", "long"])
def test_exclusions_reach_every_block_and_vectors_collapse(spark, kind):
    """Integer ids, equal vectors and many blocks: no seed comes back, rows as by brute force."""
    rng = np.random.default_rng(3)
    kinds = [sorted(rng.choice(12, 3, replace=False).tolist()) for _ in range(20)]
    vecs = {i: {f"t{t}": 1.0 + t % 3 for t in kinds[int(rng.integers(20))]} for i in range(60)}
    rows = [(i, t, w) for i, v in vecs.items() for t, w in v.items()]
    base = spark.createDataFrame(rows, f"id {kind}, key string, w double")
    q = base.select(F.col("id").alias("query_id"), "key", "w", F.lit(4).alias("top_n"))
    c = base.select(F.col("id").alias("cand_id"), "key", "w")
    ex = base.select(F.col("id").alias("query_id"), F.explode(F.array(
        F.col("id"), ((F.col("id") + 7) % 60).cast(kind))).alias("cand_id")).distinct()
    full = _brute(vecs, 60)
    expect = {i: [x for x in full[i] if x not in (i, (i + 7) % 60)][:4] for i in vecs}
    for block in (3, 60):
        assert _got(knn_batch(q, c, exclusions=ex, block=block)) == expect


def test_rank_keys_are_the_same_in_both_engines(spark):
    from cadenza.operators.knn import rank_key, rank_keys
    x = [0.5e-9, 0.1234567885, 1.0, 0.0, 1.5e-9, 2 / 3, 1e-16]
    df = spark.createDataFrame([(v,) for v in x], "d double")
    got = [r[0] for r in df.select(rank_key(F.col("d"))).collect()]
    assert [float(g) for g in got] == rank_keys(np.array(x)).tolist()


def test_same_result_for_1_and_8_shuffle_partitions(spark):
    import __spark_entry__ as E
    q = E.queries()["u5_training_genres"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_scan_pushdown_and_pruning(spark):
    from cadenza.operators.search import search_genres
    from cadenza.sources.catalog import read_table
    df = read_table(spark, SF_SMALL, "lineitem").where(F.col("l_linenumber") == 1).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
    assert search_genres(catalog(spark, SF_SMALL), "blue").count() > 0


def test_grid_of_blocks_equals_brute_force(spark, monkeypatch):
    """Where no bound bites, queries meet classes block by block: the same rows, none farther than found."""
    for name, value in (("GRID_SHARE", -1.0), ("GRID", 16), ("GRID_TASKS", 9), ("QUERY_CHUNK", 7), ("BLOCK", 3),
                        ("KEEP", 2), ("SALTS", 2)):
        monkeypatch.setattr(nearest, name, value)
    used = []
    grid = nearest._grid
    monkeypatch.setattr(nearest, "_grid", lambda *a: used.append(1) or grid(*a))
    rng = np.random.default_rng(9)
    kinds = [sorted(rng.choice(9, 4, replace=False).tolist()) for _ in range(30)]
    vecs = {i: {f"t{t}": 1.0 + t % 3 for t in kinds[i % 30]} for i in range(80)}
    vecs[90], vecs[91] = {"alone": 1.0}, {"alone": 2.0}        # 90 shares a token with 91 only
    base = spark.createDataFrame([(i, t, w) for i, v in vecs.items() for t, w in v.items()],
                                 "id long, key string, w double")
    q = base.select(F.col("id").alias("query_id"), "key", "w", F.lit(4).alias("top_n"))
    c = base.select(F.col("id").alias("cand_id"), "key", "w")
    ex = base.select(F.col("id").alias("query_id"), F.explode(F.array(
        "id", (F.col("id") + 30) % 80)).alias("cand_id")).distinct()
    full = _brute(vecs, 82)
    want = {i: [x for x in full[i] if x not in (i, (i + 30) % 80)][:4] for i in vecs}
    got = knn_batch(q, c, exclusions=ex)
    assert _got(got) == want and used
    assert got.where("distance < 0 or distance > 1").count() == 0


def test_cells_of_a_box_index_grow_and_share_out_their_queries(spark, monkeypatch):
    """A large box: a query sees few cells of it, no task meets all queries, one home bounds a query."""
    for name, value in (("BLOCK", 8), ("BOX_CELL", 40), ("BOX_CELLS", 2), ("MEET", 20), ("HOME", 4),
                        ("KEEP", 2), ("SALTS", 2)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(5)
    vecs = {i: {"y": 100.0, "b": float(i % 7 == 0)} | {f"t{t}": 1.0 for t in rng.choice(12, 4, replace=False)}
            for i in range(150)}
    vecs = {i: {k: w for k, w in v.items() if w} for i, v in vecs.items()}
    base = spark.createDataFrame([(i, t, w) for i, v in vecs.items() for t, w in v.items()],
                                 "id long, token string, w double")
    index = nearest.box_index(base.select(F.col("id").alias("cand_id"), F.col("token").alias("key"), "w"), "y", ["b"])
    boxes = index.boxes
    assert (boxes["salts"] == -(-boxes["n"] // 40)).all() and boxes["salts"].max() > 1
    assert (boxes["homes"] == -(-boxes["n"] // 8)).all()
    met = []
    run = nearest._met
    monkeypatch.setattr(nearest, "_met", lambda q, c, *a: met.append((q, c)) or run(q, c, *a))
    assert _got(nearest.search(index, _asked(base, 4), digits=12)) == _brute(vecs, 4)
    (home, small), (visits, cells) = met
    assert home.groupBy("query_id").count().where("count > 2").count() == 0      # a cell a box
    most = visits.groupBy("cell").count().agg(F.max("count")).first()[0]
    assert most <= 40 < 150
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 80
    assert small.groupBy("cell").count().agg(F.max("count")).first()[0] <= 30


def _cell(rng, n, base, kinds, first):
    """Vectors near one direction (``base``), some of them equal, one without a weight."""
    import pandas as pd
    keys, ws = [], []
    for i in range(n):
        own = np.sort(rng.choice(kinds, rng.integers(1, 6), replace=False)) if i else np.zeros(0, int)
        keys.append(np.concatenate([[0], own + 1]).astype(np.int64) if i else np.zeros(0, np.int64))
        ws.append(np.concatenate([[base + rng.integers(0, 3)], np.ones(len(own))]) if i else np.zeros(0))
    return pd.DataFrame({"id": first + np.arange(n), "keys": keys, "ws": ws,
                         "norm": [float(np.sqrt((w * w).sum())) for w in ws]})


@pytest.mark.parametrize("base,digits,shared", [(0.5, 9, True), (1.0, 9, False), (2000.0, 12, False)])
def test_screened_pairs_equal_all_pairs_in_full(monkeypatch, base, digits, shared):
    rng = np.random.default_rng(3)
    c = _cell(rng, 700, base, 12, 0).rename(columns={"id": "cv"})
    c["ids"], c["n_ids"] = [np.array([i, 5000 + i]) for i in c["cv"]], 2
    q = _cell(rng, 90, base, 14, 100).rename(columns={"id": "query_id"})
    q["top_n"] = rng.integers(1, 9, len(q))
    q["excluded"] = [np.sort(rng.choice(700, rng.integers(0, 4), replace=False)) for _ in range(len(q))]
    q["fkeys"] = [np.zeros(0, np.int64)] * len(q)
    q["worst"] = np.where(np.arange(len(q)) % 2, 4.0, 2e-7 if base > 9 else 0.3) * 10.0 ** digits
    mat = [np.zeros((len(f), 16)) for f in (q, c)]
    for m, f in zip(mat, (q, c), strict=True):
        for i, (k, w, n) in enumerate(zip(f["keys"], f["ws"], f["norm"], strict=True)):
            m[i, k] = w / n if n else w
    dots = mat[0] @ mat[1].T
    want = {}
    for i, x in enumerate(q["query_id"]):
        rk = np.maximum(nearest.rank_keys(np.maximum(1 - dots[i], 0.0), digits), 0)
        own = [(r, a) for j, r in enumerate(rk) if r <= q["worst"][i] and (dots[i, j] > 0 or not shared)
               for a in c["ids"][j] if a not in q["excluded"][i]]
        want[x] = sorted(own)[:q["top_n"][i]]
    monkeypatch.setattr(nearest, "_dots", None)      # no table of all products in full is made
    monkeypatch.setattr(nearest, "TILE", 64, raising=False)
    monkeypatch.setattr(nearest, "BLOCK", 100)
    hits = nearest._score(q, c, digits, shared)
    got = {x: sorted((r, a) for y, r, a in zip(hits["query_id"], hits["rk"], hits["cand_id"], strict=True)
                     if y == x) for x in q["query_id"]}
    for x in want:
        assert [a for _, a in got[x]] == [a for _, a in want[x]]
        assert np.allclose([r for r, _ in got[x]], [r for r, _ in want[x]], atol=1)


def test_equal_queries_are_searched_once(spark, monkeypatch):
    vecs = {i: {f"t{i % 7}": 1.0, f"u{i % 3}": 2.0} for i in range(420)}      # 21 vectors of 20 ids
    base = spark.createDataFrame([(i, t, w) for i, v in vecs.items() for t, w in v.items()],
                                 "id long, token string, w double")
    c = base.select(F.col("id").alias("cand_id"), F.col("token").alias("key"), "w")
    ex = spark.createDataFrame([(i, j) for i in vecs for j in ([i] if i % 2 else range(i % 9, 400, 2))],
                               "query_id long, cand_id long")
    asked = []
    met = nearest._met
    monkeypatch.setattr(nearest, "_met", lambda a, *x, **k: asked.append(a.count()) or met(a, *x, **k))
    boxes = nearest.box_index(c, "u0", ["u1", "u2"])
    for index in (nearest.token_index(c), boxes):
        got = _got(nearest.search(index, _asked(base, 4), exclusions=ex.where("query_id % 2 = 1")))
        for i in range(1, 420, 2):
            same = [j for j in range(420) if j % 21 == i % 21 and j != i]
            assert got[i] == same[:4]
        for i in range(0, 420, 2):
            assert got[i] == [j for j in range(420) if j % 21 == i % 21][:4]
    assert asked[0] < 60        # one home each: 21 that exclude an id, 21 that exclude none
    long = _got(nearest.search(boxes, _asked(base, 4), exclusions=ex))
    for i in range(0, 420, 2):
        gone = set(range(i % 9, 400, 2))
        assert not gone & set(long[i]) and len(long[i]) == 4
        assert long[i][0] == min((j for j in range(420) if j % 21 == i % 21 and j not in gone), default=long[i][0])
