"""TF-IDF vectors and exact cosine nearest neighbours.

Vectors are kept in long form ``(entity, key, w)`` and, for single requests, as one narrow
row per entity (``terms``: array of (token, w)).  Two exact strategies:

* one request (K3): the request's centroid is a handful of numbers.  An artist's request reads the
  posting lists of its own tokens (``knn_postings``) and adds them up by artist; an album's scores every
  candidate by one expression over its own row (``knn_single``), as all albums share the year;
* a table of requests (K4, K6): an index with bounds, see ``nearest``.

Both rank on the same key, ``floor(distance * 10^digits + 0.5)``, then id.
"""

from __future__ import annotations

import json
import math
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.nearest import BLOCK, RANK_DIGITS, rank_keys, search, token_index

__all__ = ["BLOCK", "POSTING_BUCKETS", "RANK_DIGITS", "centroids", "knn_batch", "knn_postings", "knn_single",
           "missing_seeds", "posting_scores", "postings_of", "rank_key", "rank_keys", "terms_of", "tfidf"]

POSTING_BUCKETS = 64     # folders of posting lists


# ---------------------------------------------------------------- K1 TF-IDF

def tfidf(docs: DataFrame, key: str = "artist_id", tokens: str = "tokens",
          tf_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K1: raw tf, smoothed idf ``ln((1+n)/(1+df)) + 1``, L2-normalised rows.

    ``docs`` holds either a token array per entity (``tokens``) or already
    counted ``(key, token, tf)`` rows (``tf_col``).  Returns ``(vocab, vectors)``:
    vocab ``(token, df, idf)`` and vectors ``(key, token, w)``.
    """
    if tf_col is None:
        tf = (docs.select(key, F.explode(tokens).alias("token"))
              .groupBy(key, "token").agg(F.count(F.lit(1)).cast("double").alias("tf")))
        n_docs = docs.select(key).distinct().count()
    else:
        tf = docs.select(key, "token", F.col(tf_col).cast("double").alias("tf"))
        n_docs = tf.select(key).distinct().count()
    vocab = (tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
             .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0))
    raw = tf.join(vocab.select("token", "idf"), "token") \
        .select(key, "token", (F.col("tf") * F.col("idf")).alias("raw"))
    w = Window.partitionBy(key)
    vectors = raw.select(key, "token",
                         (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(w))).alias("w"))
    return vocab, vectors


# ---------------------------------------------------------------- centroids

def centroids(vectors: DataFrame, requests: DataFrame, key: str = "artist_id",
              req: str = "request_id", seeds: str = "seeds") -> DataFrame:
    """Mean of the seeds' unit vectors per request -> (request_id, token, w).

    Seeds missing from ``vectors`` are ignored here (see ``missing_seeds``).
    """
    s = requests.select(req, F.explode(F.array_distinct(seeds)).alias(key))
    found = s.join(vectors.select(key), key, "left_semi")
    n = found.groupBy(req).agg(F.count(F.lit(1)).alias("_n"))
    return (found.join(vectors, key).groupBy(req, "token").agg(F.sum("w").alias("_sw"))
            .join(n, req).select(req, "token", (F.col("_sw") / F.col("_n")).alias("w")))


def missing_seeds(requests: DataFrame, known: DataFrame, key: str = "artist_id",
                  req: str = "request_id", seeds: str = "seeds") -> DataFrame:
    """(request_id, missing array<bigint>) for requests naming unknown seeds."""
    s = requests.select(req, F.explode(F.array_distinct(seeds)).alias(key))
    return (s.join(known.select(key), key, "left_anti")
            .groupBy(req).agg(F.array_sort(F.collect_list(key)).alias("missing")))


# ---------------------------------------------------------------- ranking

def rank_key(distance, digits: int = RANK_DIGITS):
    """Distances that agree to ``digits`` tie; the same arithmetic as ``rank_keys``."""
    return F.floor(distance * F.lit(10.0 ** digits) + F.lit(0.5))


# ---------------------------------------------------------------- K3 single request

def terms_of(vectors: DataFrame, key: str = "artist_id") -> DataFrame:
    """One narrow row per entity: (key, terms array<(token, w)>, norm)."""
    return vectors.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("token", "w"))).alias("terms"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def knn_single(terms: DataFrame, centroid: dict[str, float], k: int, key: str = "artist_id",
               exclude=(), where=None, digits: int = RANK_DIGITS) -> DataFrame:
    """K3: the ``k`` candidates nearest to one centroid by cosine distance.

    Every candidate is scored (no shared token gives distance 1, as brute force does).
    ``exclude`` (the request's ids) and ``where`` (a condition on ``terms``) are applied
    *before* the top-k.
    """
    norm = math.sqrt(sum(w * w for w in centroid.values()))
    if norm > 0:
        weights = F.create_map(*[F.lit(x) for t, w in sorted(centroid.items()) for x in (t, w)])
        shared = F.filter("terms", lambda t: t["token"].isin(sorted(centroid)))
        dot = F.aggregate(shared, F.lit(0.0), lambda a, t: a + t["w"] * weights[t["token"]])
        dist = F.when(F.col("norm") > 0, 1.0 - dot / (F.lit(norm) * F.col("norm"))) \
            .otherwise(F.lit(1.0))
    else:
        dist = F.lit(1.0)
    pool = terms
    if len(exclude):
        pool = pool.where(~F.col(key).isin([int(x) for x in exclude]))
    if where is not None:
        pool = pool.where(where)
    scored = pool.select(F.col(key).cast("long").alias(key), dist.alias("distance"))
    order = [rank_key(F.col("distance"), digits), F.col(key)]
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def postings_of(terms: DataFrame, key: str = "artist_id") -> DataFrame:
    """Posting lists of ``terms``: (key, token, u, other columns, bucket), ``u`` the weight over the norm.

    Sorted by token, then id, over range partitions: a token that many hold is spread over several, and a
    list has the row groups of its token alone.  To be written by ``bucket``, so that a request opens the
    folders of its tokens only.
    """
    others = [c for c in terms.columns if c not in (key, "terms", "norm")]
    rows = terms.where("norm > 0").select(key, "norm", *others, F.explode("terms").alias("t"))
    rows = rows.select(key, F.col("t.token").alias("token"), (F.col("t.w") / F.col("norm")).alias("u"), *others,
                       F.pmod(F.crc32(F.col("t.token").cast("binary")), F.lit(POSTING_BUCKETS)).cast("int")
                       .alias("bucket"))
    order = ["bucket", "token", key]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def posting_scores(postings: DataFrame, centroid: dict[str, float], key: str = "artist_id",
                   exclude=(), where=None) -> DataFrame:
    """(key, distance) of every candidate that shares a token with a centroid whose norm is not 0."""
    tokens = sorted(centroid)
    buckets = sorted({zlib.crc32(t.encode()) % POSTING_BUCKETS for t in tokens})
    norm = math.sqrt(sum(w * w for w in centroid.values()))
    rows = postings.where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))
    if len(exclude):
        rows = rows.where(~F.col(key).isin([int(x) for x in exclude]))
    if where is not None:
        rows = rows.where(where)
    weights = F.from_json(F.lit(json.dumps({t: w / norm for t, w in centroid.items()})), "map<string,double>")
    return rows.groupBy(F.col(key).cast("long").alias(key)).agg(
        (1.0 - F.sum(F.col("u") * weights[F.col("token")])).alias("distance"))


def knn_postings(postings: DataFrame, terms: DataFrame, centroid: dict[str, float], k: int,
                 key: str = "artist_id", exclude=(), where=None,
                 digits: int = RANK_DIGITS) -> list[tuple[int, int, float]]:
    """K3 over posting lists: (rank, id, distance) of the ``k`` candidates nearest to one centroid.

    Only the lists of the centroid's tokens are read.  Candidates without any of them are at distance 1, in
    order of their ids; they are looked up (in ``terms``) only if fewer than ``k`` are nearer.  The rows
    are those of ``knn_single``.
    """
    def order(row):
        return math.floor(row[1] * 10.0 ** digits + 0.5), row[0]

    centroid = {t: w for t, w in centroid.items() if w > 0}
    scored, best = None, []
    if centroid:
        scored = posting_scores(postings, centroid, key, exclude, where)
        best = [tuple(r) for r in scored.orderBy(rank_key(F.col("distance"), digits), key).limit(k).collect()]
    if len(best) < k or order(best[-1]) >= order((0, 1.0)):
        rest = terms
        if len(exclude):
            rest = rest.where(~F.col(key).isin([int(x) for x in exclude]))
        if where is not None:
            rest = rest.where(where)
        rest = rest.select(F.col(key).cast("long").alias(key))
        if scored is not None:
            rest = rest.join(scored.select(key), key, "left_anti")
        best += [(r[0], 1.0) for r in rest.orderBy(key).limit(k).collect()]
    return [(i + 1, *row) for i, row in enumerate(sorted(best, key=order)[:k])]


# ---------------------------------------------------------------- K4 a table of requests

def knn_batch(queries: DataFrame, candidates: DataFrame, *, exclusions: DataFrame | None = None,
              block: int = BLOCK, digits: int = RANK_DIGITS) -> DataFrame:
    """K4: exact cosine top-n for a table of query vectors, by an index built for it.

    queries     (query_id, key string, w double, top_n int)
    candidates  (cand_id, key string, w double), weights not negative
    exclusions  (query_id, cand_id) removed before ranking
    returns     (query_id, cand_id, distance, rank) with rank <= top_n
    """
    return search(token_index(candidates, block), queries, exclusions=exclusions, digits=digits)
