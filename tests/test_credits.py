"""Credit bridges under a hot credit, and the scope's row limit."""

import statistics

import pytest
from pyspark.sql import functions as F

from cadenza.operators import credits
from cadenza.operators.artists import artist_features_scoped
from cadenza.plans.registry import catalog
from cadenza.sources.catalog import Catalog

from conftest import SF_SMALL


def hot_catalog(spark, rows=30_000):
    """A third of all releases and recordings on credit 7, which has two artists."""
    n = F.col("id")
    of = F.when(n % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(2000)))
    tables = {
        "release": lambda c: spark.range(rows).select("id", (n % 900).alias("release_group"), of.alias("artist_credit")),
        "recording": lambda c: spark.range(rows).select("id", of.alias("artist_credit")),
        "release_group": lambda c: spark.range(900).select("id", (n % 50).alias("artist_credit")),
        "artist_credit_name": lambda c: spark.range(2000).select(n.alias("artist_credit"), n.alias("artist")).union(
            spark.createDataFrame([(7, 5000)], "artist_credit long, artist long")),
        "l_artist_release_group": lambda c: spark.createDataFrame([(1, 5)], "entity0 long, entity1 long"),
        "l_artist_release": lambda c: spark.createDataFrame([(2, 6)], "entity0 long, entity1 long"),
        "l_artist_recording": lambda c: spark.createDataFrame([(3, 7)], "entity0 long, entity1 long"),
    }
    return Catalog(spark, tables)


def test_a_hot_credit_is_dealt_out(spark):
    cat = hot_catalog(spark)
    assert credits.hot_credits(cat) == [7]
    plain = hot_catalog(spark)
    plain._hot_credits = []
    for f in (credits.credited_release_groups, credits.credited_releases, credits.credited_recordings):
        assert sorted(map(tuple, f(cat).collect())) == sorted(map(tuple, f(plain).collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        sizes = []
        for c in (cat, plain):
            rec = c["recording"].select(F.col("id").alias("recording_id"), "artist_credit")
            rows = credits.join_credit(c, c["artist_credit_name"], rec, "recording_id")
            sizes.append([r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(sizes[0]) <= 3 * statistics.median(sizes[0])
    assert max(sizes[1]) > 3 * statistics.median(sizes[1])


def test_scope_by_max_artists(spark):
    """The first artists by id, as a scope of just these ids gives them."""
    cat = catalog(spark, SF_SMALL)
    ids = credits.eligible_artists(cat["artist"]).select("id").orderBy("id").limit(20)
    some = sorted(map(tuple, artist_features_scoped(cat, max_artists=20).collect()))
    assert some and some == sorted(map(tuple, artist_features_scoped(cat, scope=ids).collect()))
    assert {r[0] for r in some} <= {r[0] for r in ids.collect()}
    with pytest.raises(ValueError):
        credits.scope_entities(cat["artist"], 0)
