"""Model evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.knn import centroids
from cadenza.operators.nearest import TokenIndex, search, token_index
from cadenza.session import Stages, stage


def data_metrics(data: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row of data-quality counts over the model's data table."""
    null_total = None
    for c in data.columns:
        term = F.sum(F.col(c).isNull().cast("long"))
        null_total = term if null_total is None else null_total + term
    aggs = [F.count(F.lit(1)).alias("data_rows"),
            (F.count(F.lit(1)) - F.countDistinct("artist_id")).alias("duplicate_artist_ids"),
            F.count_if(F.trim(F.coalesce("genres", F.lit(""))) == "").alias("empty_genres"),
            null_total.alias("nan_total")]
    if "tag_count_sum" in data.columns:
        aggs.append(F.count_if(F.coalesce("tag_count_sum", F.lit(0)) <= 0).alias("tag_count_sum_zero_or_less"))
    # the vocabulary size is one number (the vocabulary is a genre list)
    return data.agg(*aggs).withColumn("vocab_size", F.lit(vocab.count()).cast("long"))


def token_distribution(data: DataFrame) -> DataFrame:
    """Genre tokens per row: mean, median, p95 (linear interpolation), max."""
    n = F.size(F.split(F.trim(F.coalesce("genres", F.lit(""))), r"\s+"))
    n = F.when(F.trim(F.coalesce("genres", F.lit(""))) == "", F.lit(0)).otherwise(n)
    t = data.select(n.alias("n"))
    return t.agg(F.round(F.avg("n"), 3).alias("genre_tokens_mean"),
                 F.round(F.percentile("n", 0.5), 3).alias("genre_tokens_median"),
                 F.round(F.percentile("n", 0.95), 3).alias("genre_tokens_p95"),
                 F.max("n").cast("long").alias("genre_tokens_max"))


def sample_seeds(data: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` artists (by id) with genres; None = every artist."""
    d = data.where(F.trim(F.coalesce("genres", F.lit(""))) != "").select("artist_id")
    return d if n is None else d.orderBy("artist_id").limit(n)


def prediction_metrics(features: DataFrame, vectors: DataFrame, seed_count: int | None = None,
                       top_n: int = 5, index: TokenIndex | None = None) -> DataFrame:
    """Single-seed recommendations for the sampled seeds, then quality measures.

    Latency fields of the reference become job timings (measured by the bench).
    """
    seeds = sample_seeds(features, seed_count)
    req = seeds.select(F.col("artist_id").alias("request_id"),
                       F.array("artist_id").alias("seeds"))
    cen = centroids(vectors, req)
    q = cen.select(F.col("request_id").alias("query_id"), F.col("token").alias("key"), "w",
                   F.lit(top_n).alias("top_n"))
    if index is None:
        index = token_index(vectors.select(F.col("artist_id").alias("cand_id"),
                                           F.col("token").alias("key"), "w"))
    ex = req.select(F.col("request_id").alias("query_id"), F.col("request_id").alias("cand_id"))
    with Stages() as scratch:
        recs = stage(search(index, q, exclusions=ex))      # read by four aggregates below
        scratch.release(recs)
    g = features.select("artist_id", F.array_distinct(F.split(F.trim("genres"), r"\s+")).alias("g"))
    pairs = (recs.join(g.select(F.col("artist_id").alias("query_id"), F.col("g").alias("sg")), "query_id")
             .join(g.select(F.col("artist_id").alias("cand_id"), F.col("g").alias("rg")), "cand_id"))
    u = F.size(F.array_union("sg", "rg"))
    jac = F.when(u > 0, F.size(F.array_intersect("sg", "rg")) / u)
    per_seed = recs.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("query_id") == F.col("cand_id")).alias("leak"),
        (F.count(F.lit(1)) - F.countDistinct("cand_id")).alias("dup"))
    seed_n = seeds.count()
    counts = seeds.select(F.col("artist_id").alias("query_id")).join(per_seed, "query_id", "left").agg(
        F.round(F.avg(F.coalesce("n", F.lit(0))), 3).alias("recommended_count_mean"),
        F.coalesce(F.sum("leak"), F.lit(0)).cast("long").alias("seed_leak_count"),
        F.coalesce(F.sum("dup"), F.lit(0)).cast("long").alias("recommendation_duplicate_count"))
    uniq = pairs.select(F.explode("rg").alias("t")).agg(
        F.count_distinct("t").alias("recommended_unique_genres"))
    jq = pairs.agg(F.round(F.avg(jac), 4).alias("genre_jaccard_mean"))
    out = counts.withColumn("prediction_seed_count", F.lit(seed_n).cast("long")) \
        .withColumn("prediction_top_n", F.lit(top_n))
    return _one_row_join(_one_row_join(out, jq), uniq)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side (equi-join on a constant key)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def evaluation_report(features: DataFrame, vocab: DataFrame, vectors: DataFrame,
                      seed_count: int | None = None, top_n: int = 5, run_id: str = "run",
                      index: TokenIndex | None = None) -> DataFrame:
    """Q11: data metrics + token distribution + prediction metrics in one row."""
    r = _one_row_join(data_metrics(features, vocab), token_distribution(features))
    r = _one_row_join(r, prediction_metrics(features, vectors, seed_count, top_n, index))
    return r.withColumn("run_id", F.lit(run_id))
