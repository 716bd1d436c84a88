"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The fixture catalogue (FIXTURES.md views over the supplied tables) is first
written once as parquet tables - the form a production catalogue has - and
every query then reads those tables.  Each query is timed to a full
materialisation (a write to a scratch parquet sink, so nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.plans import album_queries, all_queries, artist_queries  # noqa: E402,F401
from cadenza.plans.registry import QUERIES, use_catalog  # noqa: E402
from cadenza.session import local_session  # noqa: E402
from cadenza.sources.catalog import fixture_catalog, load_catalog, write_catalog  # noqa: E402

HEADLINE = [
    "q1_artist_features",       # artist training features (full catalogue)
    "k1_artist_vectors",        # artist model build (TF-IDF)
    "k4_artist_knn_all",        # batch kNN: every artist as a seed
    "q7_artist_recommendations",
    "q3_rg_features",           # album training features
    "q5_album_model_data",      # the album model's rows (built above)
    "q8_album_recommendations",
    "q9_profile_artist_recs",
    "q10_profile_album_recs",   # batch album kNN per listening profile
    "k6_album_neighbours_all",  # all-pairs album neighbours (every release group)
    "q11_evaluation_report",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)))
    scratch = tempfile.mkdtemp(prefix="cadenza-bench-")
    t0 = time.time()
    write_catalog(fixture_catalog(spark, sf_dir), os.path.join(scratch, "catalog"))
    t_cat = time.time() - t0
    use_catalog(spark, sf_dir, load_catalog(spark, os.path.join(scratch, "catalog"), base_dir=sf_dir))
    times, rows = {}, {}
    if not sys.argv[1:]:
        # the models that the kNN queries are served from, timed as lines of their own
        for n, build in (("build_artist_model", artist_queries._model),
                         ("build_album_model", album_queries.album_model)):
            t = time.time()
            build(spark, sf_dir)
            times[n] = round(time.time() - t, 3)
    for n in names:
        t = time.time()
        df = QUERIES[n](spark, sf_dir)
        out = os.path.join(scratch, "out", n)
        df.write.mode("overwrite").parquet(out)
        times[n] = round(time.time() - t, 3)
        rows[n] = spark.read.parquet(out).count()
    # batch kNN throughput: seconds per 1000 seeds
    k4_rows = rows.get("k4_artist_knn_all")
    extra = {}
    if k4_rows:
        seeds = spark.read.parquet(os.path.join(scratch, "out", "k4_artist_knn_all")) \
            .select("request_id").distinct().count()
        extra["k4_sec_per_1000_seeds"] = round(times["k4_artist_knn_all"] / max(seeds, 1) * 1000, 3)
        extra["k4_seeds"] = seeds
    print(json.dumps({
        "metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows": rows, "catalog_write_sec": round(t_cat, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus), **extra,
    }))


if __name__ == "__main__":
    main()
