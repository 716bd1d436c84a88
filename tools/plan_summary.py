"""Summarise physical plans of registered queries over a materialised catalogue.

usage: python tools/plan_summary.py [sf_dir] [name ...]  -> markdown on stdout
Counts the operators that matter at scale and lists every parquet scan with its
pushed filters and read schema.
"""

import os
import re
import sys
import tempfile
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadenza.plans import all_queries  # noqa: E402,F401
from cadenza.plans.registry import QUERIES, use_catalog  # noqa: E402
from cadenza.session import local_session  # noqa: E402
from cadenza.sources.catalog import fixture_catalog, load_catalog, write_catalog  # noqa: E402

OPS = ["FileScan parquet", "Exchange hashpartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "WindowGroupLimit",
       "TakeOrderedAndProject", "FlatMapCoGroupsInPandas", "BatchEvalPython", "ArrowEvalPython"]


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = args or ["q1_artist_features", "k3_artist_knn_single", "k4_artist_knn_all",
                     "k6_album_neighbours_all", "q5_album_model_data", "q8_album_recommendations",
                     "q10_profile_album_recs", "q12_top_listened"]
    spark = local_session()
    # whole filters and schemas, not their first characters
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    d = tempfile.mkdtemp(prefix="cadenza-plans-")
    write_catalog(fixture_catalog(spark, sf), d)
    use_catalog(spark, sf, load_catalog(spark, d, base_dir=sf))
    for n in names:
        plan = QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = Counter()
        for op in OPS:
            c[op] = len(re.findall(re.escape(op) + r"\b", plan))
        print(f"### {n}\n")
        print(", ".join(f"{k}: {v}" for k, v in c.items() if v) + "\n")
        for line in plan.splitlines():
            if "FileScan parquet" in line:
                tbl = re.search(r"/([a-z_]+)\.parquet", line)
                pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
                rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
                print(f"- `{tbl.group(1) if tbl else '?'}` pushed {pf.group(1) if pf else '[]'} "
                      f"read {rs.group(1) if rs else '?'}")
        print()


if __name__ == "__main__":
    main()
