"""Dense numbering over range partitions."""

from pyspark.sql import functions as F

from cadenza.functions.numbering import dense_numbers


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("n"), F.col("id"), F.lit("x").alias("k"))
    rows = dense_numbers(df, [F.desc("n"), "id"], "at", start=1).collect()
    want = sorted(((r["n"], r["id"]) for r in rows), key=lambda r: (-r[0], r[1]))
    assert [(r["n"], r["id"]) for r in sorted(rows, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in rows) == list(range(1, 5001)) and set(rows[0].asDict()) == {
        "n", "id", "k", "at"}
    assert dense_numbers(df.limit(0), ["id"], "at").count() == 0
    plan = dense_numbers(df, ["id"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
