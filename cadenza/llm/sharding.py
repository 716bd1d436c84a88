"""Sharding by sampled splitters (native): size-weighted samples, quantile bounds, ranges.

Records are ordered by (hash of the text, doc_id), so equal texts stand together, and cut into
``shards`` runs of nearly equal bytes (law ``bytes``):

1. A slim table (ids, size, checksum, order key; no text) is staged once.
2. Each record is drawn with a probability in proportion to its size; weighted quantiles of the
   drawn keys are the range bounds.  Ranges that turn out overfull are sampled again at a finer
   rate and subdivided.  The order key is unique, so a group of copies of any size subdivides too.
3. Within a range a window gives running bytes and rows; the ranges' totals (one row per range)
   give the offsets.  A record's shard is the one that holds the middle of its bytes; its slot is
   its place in the shard.

Any two shards differ by at most about two records' sizes, whatever the ranges were: the bounds
decide only how the work is dealt.

Scale: one scan of the texts, then tens of bytes a record.  Ranges grow with the rows (one per
``rows_per_range``, from ``MIN_RANGES`` to ``MAX_RANGES``); the bounds are an array literal of
that many keys, searched in log2 steps.

Defined results: null text counts as empty (size 16); rows with null doc_id come first in their
group; repeated rows are placed one by one; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import staged, text_or_empty

SHARDS = 40
ROW_BYTES = 16
MIN_RANGES, MAX_RANGES = 160, 4096
ROWS_PER_RANGE = 250_000
DRAWS_PER_RANGE = 32
OVERFULL = 2.0

KEY = ("k", "doc_id", "rid")


def _slim(docs: DataFrame) -> DataFrame:
    t = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    return rows.select(
        "doc_id", (F.octet_length("t") + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"), F.xxhash64("t").alias("k"),
        F.monotonically_increasing_id().alias("rid"))


def _key(row=None):
    return F.struct(*[(F.col(c) if row is None else F.lit(row[c]).cast("long")).alias(c)
                      for c in KEY])


def _draw(rows: DataFrame, bytes_per_draw: float, seed: int) -> DataFrame:
    """Rows drawn with probability size / bytes_per_draw (1 at most), weighted by its inverse."""
    u = F.pmod(F.xxhash64("k", "doc_id", "rid", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return rows.filter(u < F.col("size") / F.lit(bytes_per_draw)).withColumn(
        "w", F.greatest(F.col("size").cast("double"), F.lit(bytes_per_draw)))


def _quantiles(sample: DataFrame, parts) -> list:
    """The last drawn key of each of ``parts`` equal weights, per ``range`` (bounded: parts)."""
    by = Window.partitionBy("range")
    run = by.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    part = F.ceil(F.sum("w").over(run) * parts / F.sum("w").over(by))
    cut = sample.select("range", *KEY, part.alias("part")).groupBy("range", "part").agg(
        F.max(_key()).alias("key"))
    return [r["key"] for r in cut.select("key").collect()]


def _range_of(bounds: list):
    """Number of bounds below the row's key, by binary search in an array literal."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[_key(b) for b in bounds])
    steps = [1 << s for s in range(int(math.log2(len(bounds))), -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(
        F.get(array, a + s - 1) < _key(), a + s).otherwise(a))


def splitters(slim: DataFrame, ranges: int, total: int, draws: int = DRAWS_PER_RANGE,
              rounds: int = 4) -> list:
    """Sorted bounds; no range but one of a single record holds over OVERFULL times its share."""
    order = lambda b: tuple((v is not None, v or 0) for v in (b[c] for c in KEY))
    sample = _draw(slim, max(1.0, total / (ranges * draws)), 0).withColumn("range", F.lit(0))
    bounds = sorted({tuple(b): b for b in _quantiles(sample, ranges)}.values(), key=order)
    limit = OVERFULL * total / ranges
    for i in range(1, rounds):
        dealt = slim.withColumn("range", _range_of(bounds))
        full = [r["range"] for r in dealt.groupBy("range").agg(
            F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
            .filter((F.col("b") > limit) & (F.col("n") > 1)).select("range").collect()]
        if not full:
            break
        finer = _draw(dealt.filter(F.col("range").isin(full)),
                      max(1.0, total / (ranges * draws * 4 ** i)), i)
        bounds = sorted({tuple(b): b for b in bounds + _quantiles(finer, 4)}.values(), key=order)
    return bounds


def shard_documents(docs: DataFrame, shards: int = SHARDS,
                    rows_per_range: int = ROWS_PER_RANGE,
                    min_ranges: int = MIN_RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard - one row per document."""
    slim = staged(_slim(docs), "sizes")
    head = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    n, total = head["n"], head["b"] or 1
    ranges = min(MAX_RANGES, max(min_ranges, math.ceil(n / rows_per_range)))
    bounds = splitters(slim, ranges, total) if n else []
    dealt = slim.withColumn("range", _range_of(bounds))
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(dealt.groupBy("range").agg(  # one row per range
        F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), "ranges").select(
        "range", F.coalesce(F.sum("b").over(every), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(every), F.lit(0)).alias("n0"))
    inner = Window.partitionBy("range").orderBy(*KEY)
    placed = dealt.join(offsets, "range").select(
        "doc_id", "size", "text_crc32",
        (F.col("n0") + F.row_number().over(inner) - 1).alias("place"),
        (F.col("b0") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("size")).alias("before"))
    placed = placed.withColumn("shard", F.least(
        F.lit(shards - 1), F.expr(f"(2 * before + size) * {shards} div {2 * total}")).cast("int"))
    placed = staged(placed.drop("before"), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
