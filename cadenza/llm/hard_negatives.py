r"""Hard-negative mining by Strassen products of integer tiles.

Vectors become integers, floor(256 * x), so every inner product is exact.  Candidates are dealt to
blocks of about ``BLOCK`` rows, anchors to blocks of ``ANCHORS`` rows.

1. Positives: anchors meet the candidate blocks of their own label.
2. Negatives: each anchor now has a window of scores for each of its positives, and meets blocks of
   all rows, in which those of its own label are masked.

A cell (anchor block, candidate block) is one task: its scores are the product of two int64 tiles by
``strassen`` (padded with zeros, seven half-size products instead of eight, down to ``LEAF``), taken
``CHUNK`` anchors at a time.  A row of scores in order (score, then id) is the heap that a cell sends
on: its first five positives, or its first five scores within each window.  Such heaps merge by rank.
int64 sums may wrap on the way and are still exact, as every score fits (Cauchy-Schwarz, see below).

Scale: the anchors against all rows, in blocks; a cell's memory is bounded by its block sizes; a
label held by a third of all rows is many blocks; a cell emits heaps, never its pairs.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no
part, nor do those whose integer vector has a squared length of 2**62 or more (scores could pass 64
bits); shorter vectors are padded with zeros (an empty vector scores 0); repeated rows count as often
as they stand, also those of the anchor's own id, but a row is not its own partner; further ties are
between equal ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import staged

EVERY, MOVED, LABELS = 100, 7, 10
TOP = 5
LOW, HIGH = 80, 100         # percent of the positive's score
SCALE = 256.0
BLOCK, ANCHORS, CHUNK = 2048, 8192, 256
LEAF = 16
NEVER = -(2 ** 62)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for integer matrices; odd sizes are padded with zeros."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (2 * hm, 2 * hk) != a.shape:
        a = np.pad(a, ((0, 2 * hm - m), (0, 2 * hk - k)))
    if (2 * hk, 2 * hn) != b.shape:
        b = np.pad(b, ((0, 2 * hk - k), (0, 2 * hn - n)))
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * hm, 2 * hn), p1.dtype)
    out[:hm, :hn] = p1 + p4 - p5 + p7
    out[:hm, hn:] = p3 + p5
    out[hm:, :hn] = p2 + p4
    out[hm:, hn:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def matrix(column, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to ``width``."""
    size = np.array([len(v) for v in column], np.int64)
    out = np.zeros((len(size), width), np.int64)
    if len(size):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = \
            np.concatenate([np.asarray(v, np.int64) for v in column])
    return out


def integer_rows(vectors: DataFrame, moved: int = MOVED, labels: int = LABELS) -> DataFrame:
    """rid, vec_id, label, q: usable rows, staged once so that ``rid`` stands."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("label").cast("long").alias("label"), e.alias("e"))
    rows = rows.filter("vec_id is not null and label is not null and e is not null").filter(
        ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    q = F.transform("e", lambda x: F.floor(x * SCALE))
    size = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double")
                       * F.floor(x * SCALE).cast("double"))
    # floor saturates beyond 64 bits; such rows are out by the doubles themselves
    wide = F.exists("e", lambda x: F.abs(x * SCALE) >= 2.0 ** 31)
    rows = rows.filter(~wide).filter(size < 2.0 ** 62)
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels) \
        .otherwise(F.col("label"))
    return staged(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id",
                              label.alias("label"), q.alias("q")), "integers")


def _ranked(scores: np.ndarray) -> np.ndarray:
    """Columns of each row by score, highest first; equal ones stay in their order (by id)."""
    return np.argsort(-scores, axis=1, kind="stable")


def _sides(cell: pd.DataFrame, width: int):
    """Anchors of a cell, its candidates by id, and their tile."""
    ask = cell["ask"].to_numpy()
    cands = cell[~ask].sort_values(["vec_id", "rid"])
    return cell[ask], cands, matrix(cands["q"], width).T


def _frame(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    """Rows of equally long arrays; single numbers go for a whole part."""
    size = [len(p[-1]) for p in parts]
    cols = zip(*parts, strict=True) if parts else [[] for _ in names]
    return pd.DataFrame({n: np.concatenate([np.zeros(0, np.int64), *[
        np.broadcast_to(x, k) for x, k in zip(c, size, strict=True)]])
        for n, c in zip(names, cols, strict=True)})


def _positives(width: int, top: int):
    def run(cell):
        a, c, tile = _sides(cell, width)
        rid, ids, out = c["rid"].to_numpy(), c["vec_id"].to_numpy(), []
        for i in range(0, len(a), CHUNK):
            part = a.iloc[i:i + CHUNK]
            scores = strassen(matrix(part["q"], width), tile)
            order = _ranked(scores)[:, :top + 1]
            for j, own in enumerate(part["rid"].tolist()):
                at = order[j][rid[order[j]] != own][:top]
                out.append((own, rid[at], ids[at], scores[j, at]))
        return _frame(["anchor", "rid", "vec_id", "score"], out)

    return run


def _negatives(width: int, top: int, low: int, high: int):
    def run(cell):
        a, c, tile = _sides(cell, width)
        rid, ids, labels, out = (c["rid"].to_numpy(), c["vec_id"].to_numpy(),
                                 c["label"].to_numpy(), [])
        for i in range(0, len(a), CHUNK):
            part = a.iloc[i:i + CHUNK]
            scores = strassen(matrix(part["q"], width), tile)
            # below every window: only a positive score of 0 or more has one
            scores[part["label"].to_numpy()[:, None] == labels[None, :]] = NEVER
            order = _ranked(scores)
            falling = -np.take_along_axis(scores, order, axis=1)
            for j, (own, windows) in enumerate(zip(part["rid"].tolist(), part["windows"],
                                                   strict=True)):
                for place, positive in enumerate(map(int, windows)):
                    # Python integers: low * positive <= high * score <= high * positive
                    least = -((-low * positive) // high)
                    if least > positive:
                        continue
                    start = np.searchsorted(falling[j], -positive, "left")
                    end = np.searchsorted(falling[j], -least, "right")
                    at = order[j, start:min(end, start + top)]
                    out.append((own, place, rid[at], ids[at], scores[j, at]))
        return _frame(["anchor", "place", "rid", "vec_id", "score"], out)

    return run


def merged(heaps: DataFrame, by: list[str], top: int) -> DataFrame:
    """The first ``top`` of each group of heaps, by score, then id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "rid")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def hard_negatives(vectors: DataFrame, every: int = EVERY, top: int = TOP, low: int = LOW,
                   high: int = HIGH, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = integer_rows(vectors)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width"),
                    F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()  # one row
    width = max(size["width"] or 1, 1)
    wide, deep = max(1, -(-size["n"] // block)), max(1, -(-(size["asked"] or 0) // anchors))

    def dealt(salt: int, n) -> Column:
        return F.pmod(F.xxhash64("rid", F.lit(salt)), n).cast("int")

    def upto(n) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    asked = rows.filter(F.col("vec_id") % every == 0).withColumn(
        "ask_block", dealt(1, F.lit(deep)))
    no_windows = F.array().cast("array<bigint>")
    fields = ["label", "block", "ask_block", "ask", "rid", "vec_id", "q", "windows"]
    # positives: blocks of one label, against the anchors of that label
    own = staged(rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
        F.count_if(F.col("vec_id") % every == 0).alias("asked")).filter("asked > 0"), "labels")
    cands = rows.join(own, "label").withColumn("block", dealt(2, F.col("blocks"))).select(
        "*", upto(F.lit(deep)).alias("ask_block"), F.lit(False).alias("ask"),
        no_windows.alias("windows"))
    met = asked.join(own, "label").select(
        "*", upto(F.col("blocks")).alias("block"), F.lit(True).alias("ask"),
        no_windows.alias("windows"))
    heaps = cands.select(fields).unionByName(met.select(fields)).groupBy(
        "label", "block", "ask_block").applyInPandas(
        _positives(width, top), "anchor long, rid long, vec_id long, score long")
    positives = staged(merged(heaps, ["anchor"], top).select(
        "anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    # negatives: blocks of all rows, against the anchors and their windows
    windows = positives.groupBy(F.col("anchor").alias("rid")).agg(F.sort_array(F.collect_list(
        F.struct("place", "positive_score"))).alias("windows"))  # ``top`` at most
    cands = rows.select("*", dealt(3, F.lit(wide)).alias("block"), upto(F.lit(deep)).alias("ask_block"),
                        F.lit(False).alias("ask"), no_windows.alias("windows"))
    met = asked.join(windows.withColumn("windows", F.transform(
        "windows", lambda w: w["positive_score"])), "rid").select(
        "*", upto(F.lit(wide)).alias("block"), F.lit(True).alias("ask"))
    heaps = cands.select(fields).unionByName(met.select(fields)).groupBy(
        "block", "ask_block").applyInPandas(
        _negatives(width, top, low, high),
        "anchor long, place int, rid long, vec_id long, score long")
    best = merged(heaps, ["anchor", "place"], top).withColumnsRenamed(
        {"vec_id": "negative_id", "score": "negative_score"})
    ids = asked.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return best.join(positives, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
with e as (select row_number() over () rid, vec_id, embedding e,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end label
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select rid, vec_id, label, list_transform(e, lambda x: floor(256 * x::double)::bigint) q from e),
s as (select a.rid anchor, a.vec_id anchor_id, c.rid, c.vec_id, a.label = c.label same,
    list_sum(list_transform(list_zip(a.q, c.q), lambda z:
      coalesce(z[1], 0)::hugeint * coalesce(z[2], 0)))::bigint score
  from v a join v c on a.rid <> c.rid where a.vec_id % 100 = 0),
p as (select * from s where same
  qualify row_number() over (partition by anchor order by score desc, vec_id, rid) <= 5)
select p.anchor_id, p.vec_id positive_id, row_number() over (partition by p.anchor, p.rid
    order by n.score desc, n.vec_id, n.rid)::int rank,
  n.vec_id negative_id, p.score positive_score, n.score negative_score
from p join s n on n.anchor = p.anchor and not n.same
where 80::hugeint * p.score <= 100::hugeint * n.score and n.score <= p.score
qualify rank <= 5
"""
