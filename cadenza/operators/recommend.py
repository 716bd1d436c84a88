"""Artist model build (Q4), recommendation (K3/K4 + P4/P11/P12 + Q6), enrichment."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.scalars import ARTIST_PAGE, capitalize_first, official_site
from cadenza.operators.artists import artist_training_features
from cadenza.operators.credits import recommendable_artists
from cadenza.operators.knn import (centroids, knn_postings, missing_seeds, postings_of,
                                   terms_of, tfidf, RANK_DIGITS)
from cadenza.operators.nearest import TokenIndex, search, token_index
from cadenza.session import Stages, stage


@dataclass
class ArtistModel:
    features: DataFrame   # Q1 rows (artist_id, ..., genres, tokens)
    vocab: DataFrame      # (token, df, idf)
    vectors: DataFrame    # (artist_id, token, w), unit rows
    terms: DataFrame      # (artist_id, terms, norm, recommendable), one row per artist
    postings: DataFrame   # (artist_id, token, u, recommendable, bucket), a folder a bucket of tokens
    cards: DataFrame      # (artist_id, gid, name, genres, urls, official_site): A13, by artist_id
    _index: TokenIndex | None = None

    def index(self) -> TokenIndex:
        """The index of tables of requests, built when first used."""
        if self._index is None:
            ok = self.terms.select("artist_id", F.col("recommendable").alias("ok"))
            self._index = token_index(self.vectors.join(ok, "artist_id").select(
                F.col("artist_id").alias("cand_id"), F.col("token").alias("key"), "w", "ok"))
        return self._index


def build_artist_model(cat, min_tag_count: int = 1, staging: str = "checkpoint",
                       features: DataFrame | None = None) -> ArtistModel:
    """Q4: features -> (P3 inside Q1) -> TF-IDF; each stage's lineage is cut."""
    with Stages() as scratch:
        feats = features if features is not None else artist_training_features(cat, min_tag_count)
        feats = stage(feats, staging)
        vocab, vectors = tfidf(feats)
        vectors = stage(vectors, staging)
        ok = recommendable_artists(cat).select(F.col("id").alias("artist_id")).distinct() \
            .withColumn("recommendable", F.lit(True))
        terms = terms_of(vectors).join(ok, "artist_id", "left").withColumn(
            "recommendable", F.coalesce("recommendable", F.lit(False)))
        terms = stage(by_id(terms), staging)
        cards = enrich_artists(cat, feats.select("artist_id"))
        model = ArtistModel(feats, stage(vocab, staging), vectors, terms,
                            stage(postings_of(terms), staging, by=["bucket"]), stage(by_id(cards), staging))
        # the model alone is left
        scratch.release(feats, model.vocab, vectors, terms, model.postings, model.cards)
    return model


def by_id(df: DataFrame, key: str = "artist_id") -> DataFrame:
    """Sorted by id over its files, so that a read of a few ids skips most row groups."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


def ids_df(spark: SparkSession, ids, name: str = "id") -> DataFrame:
    """A python id list as a one-column relation."""
    return spark.createDataFrame([(int(i),) for i in (ids or [])],
                                 T.StructType([T.StructField(name, T.LongType())]))


def with_rank(spark: SparkSession, ids, name: str = "id") -> DataFrame:
    """An ordered id list as (rank, id) rows (``unnest ... WITH ORDINALITY``)."""
    return spark.createDataFrame([(i + 1, int(x)) for i, x in enumerate(ids or [])],
                                 f"rank int, {name} long")


def filter_recommendable_ordered(cat, ranked: DataFrame, key: str = "id") -> DataFrame:
    """Q6 on an ordered candidate list: keep Person/Group artists credited on an RG or
    release, order (``rank``) kept."""
    ok = recommendable_artists(cat).withColumnRenamed("id", key)
    return ranked.join(ok, key, "left_semi").orderBy("rank")


def validate_request(seeds, top_n: int, lo: int = 1, hi: int = 50):
    if not seeds:
        raise ValueError("at least one seed is required")
    if not (lo <= int(top_n) <= hi):
        raise ValueError(f"top_n must be in [{lo}, {hi}]")


def mean_vector(rows) -> dict[str, float]:
    """A16 for one request: the mean of the seeds' ``terms`` (as many rows as seeds)."""
    total: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: r[0]):
        for t in r["terms"]:
            total[t["token"]] = total.get(t["token"], 0.0) + t["w"]
    return {t: w / len(rows) for t, w in total.items()}


def recommend_artists(model: ArtistModel, seeds, top_n: int = 5, blacklist=None,
                      filter_recommendable: bool = True) -> DataFrame:
    """K3 + P4 + Q6 for one request -> (rank, artist_id, distance, status).

    Seeds, blacklist and artists that may not be recommended are out before the top-k, so
    ``top_n`` rows come back whenever that many exist.  Unknown seeds raise (P11); fewer
    than ``top_n`` results mark ``status`` 'short' (P12).
    """
    validate_request(seeds, top_n)
    seeds = sorted({int(s) for s in seeds})
    rows = model.terms.where(F.col("artist_id").isin(seeds)).collect()   # one row per seed
    miss = sorted(set(seeds) - {r["artist_id"] for r in rows})
    if miss:
        raise LookupError(f"unknown artist ids: {miss}")
    top = knn_postings(model.postings, model.terms, mean_vector(rows), int(top_n),
                       exclude=set(seeds) | {int(b) for b in blacklist or []},
                       where=F.col("recommendable") if filter_recommendable else None)
    return local_rows(model.terms.sparkSession, top, "artist_id", top_n)


def local_rows(spark: SparkSession, rows: list[tuple], key: str, top_n: int) -> DataFrame:
    """One request's (rank, id, distance), ``top_n`` at most, with P12's status, as a local relation:
    what follows reads it without a job of its own."""
    status = "ok" if len(rows) >= top_n else "short"
    names = pa.schema([("rank", pa.int32()), (key, pa.int64()), ("distance", pa.float64()),
                       ("status", pa.string())])
    columns = zip(*[(*r, status) for r in rows], strict=True) if rows else [[]] * 4
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, names, strict=True)],
                                          schema=names))


def valid_requests(requests: DataFrame, lo: int = 1, hi: int = 100) -> DataFrame:
    """Requests with a seed at least and ``top_n`` in [lo, hi]."""
    return requests.where((F.size(F.coalesce("seeds", F.array().cast("array<long>"))) > 0)
                          & F.col("top_n").between(lo, hi))


def recommend_artists_batch(model: ArtistModel, requests: DataFrame,
                            filter_recommendable: bool = True, staging: str = "checkpoint") -> DataFrame:
    """K4: (request_id, seeds, blacklist, top_n) -> (request_id, rank, artist_id, distance).

    Requests that are invalid or name unknown seeds have no neighbours: ``with_outcome``
    gives them their row.  The result is staged (lineage cut) because enrichment and reports
    read it several times.
    """
    requests = valid_requests(requests)
    ok = requests.join(missing_seeds(requests, model.features), "request_id", "left_anti")
    cen = centroids(model.vectors, ok)
    q = cen.join(ok.select("request_id", "top_n"), "request_id").select(
        F.col("request_id").alias("query_id"), F.col("token").alias("key"), "w", "top_n")
    bl = F.coalesce("blacklist", F.array().cast("array<long>"))
    ex = ok.select(F.col("request_id").alias("query_id"),
                   F.explode(F.array_distinct(F.concat(F.col("seeds").cast("array<long>"),
                                                       bl.cast("array<long>")))).alias("cand_id"))
    index = model.index()
    with Stages() as scratch:
        res = search(index, q, exclusions=ex, only_ok=filter_recommendable)
        res = stage(res.select(F.col("query_id").alias("request_id"), "rank",
                               F.col("cand_id").alias("artist_id"), "distance"), staging)
        scratch.release(res)
    return res


def with_outcome(recs: DataFrame, requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """P11 + P12 for a table of requests: ``recs`` plus ``status``, and one row (all else
    null) for each request without a recommendation, so that no request vanishes.

    status: 'invalid' (no seed, or ``top_n`` out of range), 'unknown_seeds', 'short' (fewer
    than ``top_n``) or 'ok'.
    """
    valid = valid_requests(requests).select("request_id", F.lit(True).alias("_valid"))
    miss = missing_seeds(requests, known, key=key).select("request_id", F.lit(True).alias("_miss"))
    n = recs.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    status = (requests.select("request_id", "top_n").join(valid, "request_id", "left")
              .join(miss, "request_id", "left").join(n, "request_id", "left")
              .select("request_id", F.when(F.col("_valid").isNull(), "invalid")
                      .when(F.col("_miss").isNotNull(), "unknown_seeds")
                      .when(F.coalesce("_n", F.lit(0)) < F.col("top_n"), "short")
                      .otherwise("ok").alias("status")))
    return status.join(recs, "request_id", "left")


def enrich_artists(cat, ranked: DataFrame, key: str = "artist_id") -> DataFrame:
    """A13 + J14: id, gid, name, capitalised distinct genres, distinct urls.

    Genres and URLs are aggregated per artist *before* they meet, so the
    genre x url product of the naive join never exists.
    """
    ids = ranked.select(F.col(key).alias("id")).distinct()
    tag = cat["tag"].select(F.col("id").alias("tag"), F.col("name").alias("tname"))
    genre = cat["genre"].select(F.col("name").alias("tname"))
    g = (cat["artist_tag"].where(F.col("count") >= 1).join(ids.withColumnRenamed("id", "artist"),
                                                          "artist", "left_semi")
         .join(tag, "tag").join(genre, "tname")
         .groupBy(F.col("artist").alias("id"))
         .agg(F.array_sort(F.transform(F.collect_set("tname"), capitalize_first)).alias("genres")))
    url = cat["url"].select(F.col("id").alias("entity1"), "url")
    link = cat["link"].where(F.col("link_type").isNotNull()).select(
        F.col("id").alias("link"), F.col("link_type").alias("type"))
    u = (cat["l_artist_url"].join(ids.withColumnRenamed("id", "entity0"), "entity0", "left_semi")
         .join(url, "entity1").join(link, "link")
         .groupBy(F.col("entity0").alias("id"))
         .agg(F.array_sort(F.collect_set(F.struct("url", F.col("type").cast("int").alias("type"))))
              .alias("urls")))
    art = cat["artist"].select("id", "gid", "name").join(ids, "id", "left_semi")
    return (ranked.join(art.withColumnRenamed("id", key), key)
            .join(g.withColumnRenamed("id", key), key, "left")
            .join(u.withColumnRenamed("id", key), key, "left")
            .withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))
            .withColumn("urls", F.coalesce("urls", F.array().cast(
                "array<struct<url:string,type:int>>")))
            .withColumn("official_site", official_site("urls")))


def with_cards(model: ArtistModel, ranked: DataFrame) -> DataFrame:
    """A13 from the model's cards: what ``enrich_artists`` gives, for a few rows a read of theirs."""
    return ranked.join(model.cards, "artist_id")


def one_request_cards(model: ArtistModel, ranked: DataFrame) -> DataFrame:
    """``with_cards`` for one request's rows: only their ids are read."""
    ids = [r[0] for r in ranked.select("artist_id").collect()]     # a local table
    return ranked.join(model.cards.where(F.col("artist_id").isin(ids)), "artist_id")


def artist_digest(enriched: DataFrame) -> DataFrame:
    """One markdown text per request from enriched, ranked artists."""
    line = F.concat_ws("\n",
                       F.concat(F.lit("- **"), F.coalesce("name", F.lit("")), F.lit("**")),
                       F.when(F.size("genres") > 0,
                              F.concat(F.lit("  Genres: "), F.array_join("genres", ", "))),
                       F.concat(F.lit(f"  [ListenBrainz]({ARTIST_PAGE}"), F.col("gid"),
                                F.lit(")"),
                                F.when(F.col("official_site").isNotNull(),
                                       F.concat(F.lit(" | [Official site]("), F.col("official_site"),
                                                F.lit(")"))).otherwise(F.lit(""))))
    return (enriched.groupBy("request_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("_b"))
            .select("request_id", F.concat(F.lit("# Recommended artists\n\n"),
                                           F.array_join(F.transform("_b", lambda b: b["l"]), "\n"))
                    .alias("digest")))


__all__ = ["ArtistModel", "build_artist_model", "recommend_artists", "recommend_artists_batch",
           "enrich_artists", "with_cards", "one_request_cards", "artist_digest", "with_outcome", "ids_df", "RANK_DIGITS"]
