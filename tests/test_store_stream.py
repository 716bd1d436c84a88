"""Model artefact round trip (S5/S6), metrics upsert (S7), feature cache (S4), streaming Q12."""

import os
import tempfile

from pyspark.sql import functions as F

from cadenza.operators.recommend import build_artist_model
from cadenza.plans.registry import catalog
from cadenza.sources import store
from cadenza.streaming.listens import (compact_listen_counts, listens_of, read_listen_counts, start_listen_counts,
                                       windowed_listen_counts)

from conftest import SF_SMALL


def test_model_roundtrip_and_cache(spark):
    cat = catalog(spark, SF_SMALL)
    m = build_artist_model(cat, staging="checkpoint")
    d = tempfile.mkdtemp(prefix="cadenza-test-")
    path = store.save_model(m, d, meta={"min_tag_count": 1})
    m2, meta = store.load_model(spark, path)
    assert meta["min_tag_count"] == 1
    for a, b in [(m.vectors, m2.vectors), (m.vocab, m2.vocab), (m.features, m2.features)]:
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    calls = []

    def build():
        calls.append(1)
        return m.features.select("artist_id", "genres")
    a = store.cached_features(spark, os.path.join(d, "cache"), {"min_tag_count": 1}, build)
    b = store.cached_features(spark, os.path.join(d, "cache"), {"min_tag_count": 1}, build)
    assert len(calls) == 1 and a.count() == b.count()
    store.cached_features(spark, os.path.join(d, "cache"), {"min_tag_count": 2}, build)
    assert len(calls) == 2


def test_album_model_roundtrip(spark):
    from cadenza.operators import albums
    from cadenza.plans.album_queries import album_model
    m = album_model(spark, SF_SMALL)
    m2, meta = store.load_model(spark, store.save_model(m, tempfile.mkdtemp(prefix="cadenza-test-")))
    assert meta["model_kind"] == "album_knn" and m2.stats.asDict() == m.stats.asDict()
    a, b = (albums.recommend_albums(x, [0, 6], 5, [1]).orderBy("rank").collect() for x in (m, m2))
    assert a == b


def test_metrics_cycle_on_one_path(spark):
    """Read, upsert, write; a failed write and a version in between leave the store whole."""
    d = tempfile.mkdtemp(prefix="cadenza-test-")
    rows = lambda *r: spark.createDataFrame(r, "run_id string, v double")
    assert store.read_metrics(spark, d) is None
    for run, v in (("a", 1.0), ("b", 2.0), ("a", 3.0), ("c", 4.0)):
        folder = store.update_metrics(spark, d, rows((run, v)), latest_run=run)
    want = [("a", 3.0), ("b", 2.0), ("c", 4.0)]
    assert sorted(tuple(r) for r in store.read_metrics(spark, d).collect()) == want
    back = spark.read.option("header", "true").csv(os.path.join(folder, "runs_csv")).collect()
    assert sorted((r["run_id"], float(r["v"])) for r in back) == want
    assert spark.read.json(os.path.join(folder, "latest")).collect()[0]["v"] == 4.0
    assert len(os.listdir(os.path.join(d, "versions"))) == 2
    held = store.read_metrics(spark, d)                     # of the version before the next

    def torn(path):
        rows(("x", 9.0)).write.parquet(os.path.join(path, "runs"))
        raise OSError("lost")
    try:
        store.write_version(spark, d, torn)
    except OSError:
        pass
    assert store.current_version(spark, d) == folder
    store.update_metrics(spark, d, rows(("d", 5.0)))
    assert sorted(tuple(r) for r in held.collect()) == want
    try:
        store.write_metrics(rows(("e", 1.0)), d, after=folder)
        raise AssertionError("committed over another version")
    except RuntimeError:
        pass
    assert store.read_metrics(spark, d).count() == 4


def test_metrics_upsert(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "run_id string, v double")
    new = spark.createDataFrame([("b", 3.0)], "run_id string, v double")
    got = sorted(tuple(r) for r in store.upsert_metrics(old, new).collect())
    assert got == [("a", 1.0), ("b", 3.0)]


def _stream(spark, src, schema, ckpt, out, **options):
    q = start_listen_counts(spark, src, schema, ckpt, out, **options)
    try:
        q.processAllAvailable()
        return q.recentProgress
    finally:
        q.stop()


def _counts(spark, out):
    return {(r["window"]["start"], r["user_id"], r["artist"]): r["listen_count"]
            for r in read_listen_counts(spark, out).collect()}


def test_streaming_restart_equals_one_run(spark):
    """The files in two runs with one checkpoint, the last batch again: equal counts."""
    src, ckpt, out = (tempfile.mkdtemp(prefix="cadenza-stream-") for _ in range(3))
    events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    cut = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    out = os.path.join(out, "counts")
    assert read_listen_counts(spark, out) is None
    for early in (True, False):
        part = events.where((F.col("ts") <= F.lit(cut)) == F.lit(early))
        part.coalesce(1).write.mode("append").parquet(src)
        _stream(spark, src, events.schema, ckpt, out, delay="400 days")
    want = {(r["window"]["start"], r["user_id"], r["artist"]): r["listen_count"] for r in
            windowed_listen_counts(listens_of(events)).collect()}
    assert _counts(spark, out) == want
    last = sorted(f for f in os.listdir(out) if f.startswith("batch="))[-1]
    spark.read.parquet(os.path.join(out, last)).write.mode("overwrite").parquet(out + "-again")
    spark.read.parquet(out + "-again").write.mode("overwrite").parquet(os.path.join(out, last))
    assert _counts(spark, out) == want
    os.remove(os.path.join(out, "batch=0", "_SUCCESS"))     # a batch that is not whole is not read
    assert _counts(spark, out) != want


def test_streaming_counts_compacted(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="cadenza-stream-"), "counts")
    assert compact_listen_counts(spark, out) is None

    def batch(n, *rows):
        df = spark.createDataFrame([(d, u, a, c) for d, u, a, c in rows],
                                   "d string, user_id long, artist long, listen_count long")
        span = F.struct(F.col("d").cast("timestamp").alias("start"),
                        (F.col("d").cast("timestamp") + F.expr("interval 7 days")).alias("end"))
        df.select(span.alias("window"), "user_id", "artist", "listen_count").write.mode(
            "overwrite").parquet(f"{out}/batch={n}")

    def counts():
        return {(u, a): n for (_, u, a), n in _counts(spark, out).items()}

    batch(0, ("2024-01-01", 1, 7, 2), ("2024-01-01", 2, 7, 1), ("2024-01-01", None, 7, 4))
    assert compact_listen_counts(spark, out) is None            # the last batch may run again
    batch(1, ("2024-01-01", 1, 7, 5))
    batch(2, ("2024-01-01", 2, 7, 3))
    want = {(1, 7): 5, (2, 7): 3, (None, 7): 4}
    assert counts() == want and compact_listen_counts(spark, out) == 1 and counts() == want
    assert compact_listen_counts(spark, out) is None
    batch(2, ("2024-01-01", 2, 7, 6))                           # the last batch again
    assert counts() == want | {(2, 7): 6}
    held = read_listen_counts(spark, out)                       # listed before the next compaction
    batch(10, ("2024-01-01", 1, 7, 9))
    batch(11, ("2024-01-01", 3, 7, 1))
    os.remove(f"{out}/batch=11/_SUCCESS")                       # written in part
    assert compact_listen_counts(spark, out) == 2 and held.count() == 3
    want = {(1, 7): 9, (2, 7): 6, (None, 7): 4}
    assert counts() == want and sorted(os.listdir(out)) == ["batch=10", "batch=11", "batch=2", "upto=1", "upto=2"]
    os.remove(f"{out}/upto=2/_SUCCESS")                         # a compaction that failed
    assert counts() == want and compact_listen_counts(spark, out) == 2 and counts() == want


def test_streaming_late_rows_and_evicted_state(spark):
    src, ckpt, out = (tempfile.mkdtemp(prefix="cadenza-stream-") for _ in range(3))
    schema = "user_id long, ts timestamp, event_type string, props string"
    day = lambda d: f"2024-01-{d:02d} 12:00:00"

    def arrive(*days):
        rows = [(1, day(d), "click", "item 7") for d in days]
        df = spark.createDataFrame(rows, "user_id long, ts string, event_type string, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        return _stream(spark, src, schema, ckpt, out)

    arrive(2, 3)                # the week of Monday the first
    arrive(4, 9)                # the watermark is on the eighth now: the week is over
    progress = arrive(3, 8, 15)  # too late; late but counted; and a week on
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress)
    got = {k[0].day: n for k, n in _counts(spark, out).items()}
    assert got == {1: 3, 8: 2, 15: 1} and dropped == 1
    assert compact_listen_counts(spark, out) is not None and read_listen_counts(spark, out).count() == 3
    progress = arrive(24)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1   # earlier weeks are evicted
