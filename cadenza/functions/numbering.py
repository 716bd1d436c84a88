"""Dense numbers of rows in a global order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import stage

_INNER = 33     # bits of ``monotonically_increasing_id`` below the partition's number


def dense_numbers(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name`` (long): the place of each row in ``order``, from ``start`` on.

    Rows are dealt to range partitions and sorted within; a partition's first number is the sum of the
    sizes of those before it.  ``order`` has to be total for the numbers to be repeatable.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written once: a row's partition and place in it have to stand
    rows = stage(rows.withColumn("_at", F.monotonically_increasing_id()), name="order")
    rows = rows.withColumn("_part", F.shiftright("_at", _INNER))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    offsets = stage(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")),
                    name="offsets")
    inner = F.col("_at").bitwiseAND((1 << _INNER) - 1)
    return rows.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_first") + inner + start).drop("_at", "_part", "_first")
