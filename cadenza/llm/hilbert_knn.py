"""Approximate nearest neighbours by cosine over several shifted Hilbert orderings.

1. Equal vectors form one class with its smallest ``k + 1`` ids (enough for any query, itself
   excluded), so a vector shared by a third of all rows is searched once.
2. Each of ``CURVES`` orderings projects unit vectors on ``DIMS`` random orthonormal directions,
   shifts them, and orders them by the key of the cell on a Hilbert curve.
3. Each ordering is range-partitioned and numbered by Spark.  A query looks at the window of
   ``share`` of all rows (``LEAST`` at least) to either side of its own place; windows are met in
   buckets of ``BUCKET`` neighbouring rows, to which queries are sent.
4. A bucket scores its queries against its rows and keeps the ``k`` best of each query by exact
   cosine, then id (all rows that tie with the k-th within rounding are looked at); these merge across
   buckets and orderings.

Vectors without cluster structure (as in the test tables: the 64 directions carry alike) have no
short windows that hold the neighbours, whatever the curve: the window is therefore a share of all
rows, and the cost is that of queries x rows in blocks.  On clustered data a smaller ``share``
suffices.  Only the projected values' spread is fitted, on ``SAMPLE`` rows at most (those with the
smallest hashes); every row is indexed.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of the
commonest length (of equally common ones the longest), and rows with a null id, take no part; rows
repeated with the same id and vector count once; a query's own id never is its neighbour; ties go
to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import staged

K = 5
EVERY = 50
CURVES, DIMS, BITS = 16, 8, 4
SHARE, LEAST = 0.05, 256
BUCKET = 1024
PART = 2048             # queries that meet a bucket in one task
SAMPLE = 4096
SEED = 5
ROUNDING = 1e-9         # more than products in another order differ by


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (n, dims) along the Hilbert curve of that many bits an axis.

    From the top bit on, each axis with its bit set mirrors the first axis' lower bits, each
    other axis swaps them with the first's; then the bits are Gray-decoded and interleaved.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(axes)):
            bit = (axes[i] >> b) & 1 == 1
            other = np.where(bit, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ np.where(bit, low, other)
            axes[i] = axes[i] ^ other if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for x in axes:
            key = key << 1 | ((x ^ flip) >> b) & 1
    return key


def directions(size: int, curves: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(curves, size, dims) orthonormal directions and (curves, dims) shifts in 0..1."""
    rng = np.random.default_rng([SEED, size])
    dims = min(dims, size)
    turns = [np.linalg.qr(rng.normal(size=(size, dims)))[0] for _ in range(curves)]
    return np.array(turns), rng.random((curves, dims))


def matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, size)


def classes_of(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(cid, vec, ids) of distinct vectors, (query id, cid) of all rows, and their length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("e"))
    usable = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists("e", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(usable)
    length = rows.groupBy(F.size("e").alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")).first()  # one row
    size = length["size"] if length else 1
    rows = rows.filter(F.size("e") == size)
    rows = staged(rows.select("vec_id", "e", F.xxhash64("e").alias("h1"),
                              F.xxhash64("e", F.lit(1)).alias("h2")), "vectors")
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = rows.select("h1", "h2", "vec_id").withColumn("r", F.dense_rank().over(first)) \
        .filter(F.col("r") <= k + 1).groupBy("h1", "h2").agg(
            F.sort_array(F.collect_set("vec_id")).alias("ids"))  # k + 1 ids at most
    ids = staged(ids.withColumn("cid", F.monotonically_increasing_id()), "ids")
    one = rows.join(ids.select("h1", "h2", "cid", F.col("ids")[0].alias("vec_id")),
                    ["h1", "h2", "vec_id"]).dropDuplicates(["cid"]).select("cid", "e")
    known = staged(rows.select("h1", "h2", "vec_id").join(
        ids.select("h1", "h2", "cid"), ["h1", "h2"]).select("vec_id", "cid").distinct(), "known")

    def pack(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["cid", "vec"])

    packed = one.mapInArrow(pack, "cid long, vec binary")
    return staged(packed.join(ids.select("cid", "ids"), "cid"), "classes"), known, size


def curve_keys(classes: DataFrame, size: int, curves: int, dims: int, bits: int,
               sample: int = SAMPLE) -> DataFrame:
    """curve, key, cid for every class and curve."""
    turns, shifts = directions(size, curves, dims)
    seen = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vec").collect()
    known = matrix([r["vec"] for r in seen], size)
    known = known / np.linalg.norm(known, axis=1, keepdims=True)
    low, high = np.quantile(np.einsum("ns,csd->cnd", known, turns), [0.01, 0.99], axis=1)
    spread = np.maximum(high - low, 1e-12)
    low, spread = low - 0.25 * shifts * spread, 1.25 * spread

    def run(batches):
        for batch in batches:
            v = matrix(batch.column(1).to_pylist(), size)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            keys = np.empty((len(v), curves), np.int64)
            for c in range(curves):
                cell = (v @ turns[c] - low[c]) / spread[c] * (1 << bits)
                keys[:, c] = hilbert_keys(np.clip(cell, 0, (1 << bits) - 1).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(v) + 1) * curves, pa.int32()), pa.array(keys.ravel()))],
                ["cid", "keys"])

    return classes.select("cid", "vec").mapInArrow(run, "cid long, keys array<long>").select(
        F.posexplode("keys").alias("curve", "key"), "cid")


def numbered(keys: DataFrame, n: int) -> DataFrame:
    """curve, cid, place: each class's place (from 0) along each curve, by range partitions."""
    order = ["curve", "key", "cid"]
    parts = max(8, keys.sparkSession.sparkContext.defaultParallelism)
    rows = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = staged(rows.select("curve", "cid", F.monotonically_increasing_id().alias("at")), "order")
    part, inner = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    rows = rows.select("curve", "cid", part.alias("part"), inner.alias("inner"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "parts")  # one a partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        "curve", "cid", (F.col("offset") + F.col("inner") - F.col("curve") * n).alias("place"))


def _best(size: int, k: int):
    """Scores of a bucket's queries against its rows: the k best of each query."""
    def run(pdf):
        import pandas as pd
        ask = pdf["ask"].to_numpy()
        q, c = pdf[ask], pdf[~ask]
        none = pd.DataFrame({"q": [], "c": [], "score": []})
        if not len(q) or not len(c):
            return none.astype({"q": "int64", "c": "int64"})
        a, b = matrix(q["vec"], size), matrix(c["vec"], size)
        an, bn = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        rough = (a / an[:, None]) @ (b / bn[:, None]).T
        qi, ci = q["cid"].to_numpy(), c["cid"].to_numpy()
        rough[qi[:, None] == ci[None, :]] = -np.inf
        far = np.abs(q["place"].to_numpy()[:, None] - c["place"].to_numpy()[None, :])
        rough[far > q["reach"].to_numpy()[:, None]] = -np.inf
        heads = c["head"].to_numpy()
        out = []
        for i in range(len(q)):
            top = min(k, len(c))
            # every row that can be among the k best, ties within rounding included
            kth = np.partition(rough[i], len(c) - top)[len(c) - top]
            at = np.flatnonzero((rough[i] >= kth - ROUNDING) & np.isfinite(rough[i]))
            score = (a[i] * b[at]).sum(axis=1) / (an[i] * bn[at])
            best = np.lexsort((heads[at], -score))[:top]
            out.append((np.full(len(best), qi[i]), ci[at[best]], score[best]))
        return pd.DataFrame(dict(zip(["q", "c", "score"], map(np.concatenate, zip(*out, strict=True)),
                                     strict=True)))

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, curves: int = CURVES,
            dims: int = DIMS, bits: int = BITS, share: float = SHARE, least: int = LEAST,
            bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id ``every`` divides."""
    classes, known, size = classes_of(vectors, k)
    n = classes.count()
    asked = staged(known.filter(F.col("vec_id") % every == 0).withColumnRenamed(
        "vec_id", "query_id"), "queries")
    if not n:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double")
    places = staged(numbered(curve_keys(classes, size, curves, dims, bits), n), "places")
    reach = max(least, int(np.ceil(share * n)))
    vecs = classes.select("cid", "vec", F.col("ids")[0].alias("head"))
    rows = places.join(vecs, "cid").select(
        "curve", F.expr(f"place div {bucket}").alias("bucket"), F.lit(False).alias("ask"), "cid",
        "place", F.lit(0).cast("long").alias("reach"), "vec", "head")
    queries = places.join(asked.select("cid").distinct(), "cid").select(
        "curve", F.explode(F.expr(
            f"sequence(greatest(place - {reach}, 0L) div {bucket}, "
            f"least(place + {reach}, {n - 1}L) div {bucket})")).alias("bucket"),
        F.lit(True).alias("ask"), "cid", "place", F.lit(reach).cast("long").alias("reach"))
    queries = queries.join(vecs, "cid").select(rows.columns)
    # a bucket's queries in parts of about ``PART``, so that a group does not grow with the queries
    parts = max(1, int(np.ceil(asked.count() * (2 * reach + bucket) / n / PART)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int"))
    found = rows.unionByName(queries).groupBy("curve", "bucket", "part").applyInPandas(
        _best(size, k), "q long, c long, score double")
    found = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    # ties between classes go to the smaller id: a class's first
    heads = classes.select(F.col("cid").alias("c"), "ids")
    found = found.join(heads, "c")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    own = asked.select("cid").distinct().join(classes, "cid").mapInArrow(
        _self(size), "q long, ids array<long>, score double")
    found = staged(found.select("q", "ids", "score").unionByName(own), "found")
    pairs = asked.join(found, asked["cid"] == found["q"]).select(
        "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _self(size: int):
    """A class's own score, for its other ids."""
    def run(batches):
        for batch in batches:
            v = matrix(batch.column("vec").to_pylist(), size)
            norm = np.linalg.norm(v, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("ids"),
                 pa.array((v * v).sum(axis=1) / (norm * norm))], ["q", "ids", "score"])

    return run
