"""Listening profiles: range bounds, stats JSON source (S8), outcomes of requests."""

import datetime as dt
import json
import os
import tempfile

from cadenza.operators import profile


def test_range_bounds():
    now = dt.datetime(2024, 1, 30, 12, 0)          # a Tuesday
    assert profile.range_bounds("this_week", now)[0] == dt.datetime(2024, 1, 29)
    assert profile.range_bounds("week", now) == (dt.datetime(2024, 1, 22), dt.datetime(2024, 1, 29))
    assert profile.range_bounds("month", now) == (dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 1))
    assert profile.range_bounds("year", now) == (dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 1))
    assert profile.range_bounds("all_time", now)[0] is None


def test_read_listen_stats_strict_threshold(spark):
    d = tempfile.mkdtemp(prefix="cadenza-stats-")
    p = os.path.join(d, "stats.json")
    with open(p, "w") as f:
        json.dump({"payload": {"artists": [
            {"artist_mbid": "gid-1", "listen_count": 5},
            {"artist_mbid": "gid-2", "listen_count": 6},
            {"artist_mbid": "gid-3", "listen_count": 9}]}}, f)
    rows = profile.read_listen_stats(spark, p, "artists", 5).collect()
    assert sorted(r["artist_mbid"] for r in rows) == ["gid-2", "gid-3"]     # 5 is not > 5


def test_no_request_vanishes(spark):
    from cadenza.operators.recommend import recommend_artists_batch, with_outcome
    from cadenza.plans.artist_queries import _model
    from conftest import SF_SMALL
    m = _model(spark, SF_SMALL)
    known = [r[0] for r in m.features.select("artist_id").orderBy("artist_id").limit(3).collect()]
    n = m.terms.where("recommendable").count()
    req = spark.createDataFrame(
        [(1, known[:2], [known[2]], 5), (2, [known[0], 10**9], [], 5), (3, [], [], 5),
         (4, None, None, 5), (5, known[:1], None, 0), (6, known[:1], None, 100)],
        "request_id long, seeds array<long>, blacklist array<long>, top_n int")
    out = with_outcome(recommend_artists_batch(m, req), req, m.features, "artist_id").collect()
    status = {r["request_id"]: r["status"] for r in out}
    assert status == {1: "ok", 2: "unknown_seeds", 3: "invalid", 4: "invalid", 5: "invalid",
                      6: "ok" if n > 100 else "short"}
    for i in (2, 3, 4, 5):
        assert [r["rank"] for r in out if r["request_id"] == i] == [None]


def test_release_listens_hold_every_release_of_every_listen(spark):
    """From the supplied tables themselves, not through the views."""
    import re
    from collections import Counter, defaultdict

    from cadenza.sources.catalog import fixture_catalog, read_table
    from conftest import SF_SMALL
    releases = defaultdict(list)
    for r in read_table(spark, SF_SMALL, "orders").select("o_orderkey", "o_custkey").collect():
        releases[r["o_custkey"]].append(f"rel-{r['o_orderkey']}")
    events = [r for r in read_table(spark, SF_SMALL, "events").collect()
              if r["event_type"] in ("click", "view", "purchase")]
    want = Counter((r["user_id"], r["ts"], r["event_type"], gid) for r in events
                   for gid in releases[int(re.search("[0-9]+", r["props"])[0])])
    got = Counter(tuple(r) for r in fixture_catalog(spark, SF_SMALL)["release_listens"].select(
        "user_id", "ts", "event_type", "release_gid").collect())
    assert want and got == want


def test_langid_crossval_accuracy(spark):
    from cadenza.operators.langid import crossval_accuracy
    from cadenza.sources.catalog import read_table
    from conftest import SF_SMALL
    rows = crossval_accuracy(read_table(spark, SF_SMALL, "documents")).collect()
    n = sum(r["n"] for r in rows)
    correct = sum(r["correct"] for r in rows)
    assert n == read_table(spark, SF_SMALL, "documents").count()     # every document scored
    assert correct / n >= 0.95
