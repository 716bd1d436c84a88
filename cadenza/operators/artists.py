"""Artist feature tables (Q1, Q2), slim projection (P10) and token variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import genre_token, nonempty_tokens, strip
from cadenza.operators.credits import eligible_artists, restrict, scope_entities
from cadenza.operators.genres import (check_min_count, extended_genres, genre_tokens, listed_places,
                                      tag_genre_ci, training_genres, training_pairs)

FEATURE_COLUMNS = ["artist_id", "artist_gid", "artist_name", "artist_type", "area_name",
                   "tags", "genres", "tag_count_sum"]


def _artist_meta(cat, artists: DataFrame) -> DataFrame:
    """Artist -> type name -> area name (left joins; Spark broadcasts them where they are small)."""
    at = cat["artist_type"].select(F.col("id").alias("type"), F.col("name").alias("artist_type"))
    ar = cat["area"].select(F.col("id").alias("area"), F.col("name").alias("area_name"))
    return (artists.join(at, "type", "left").join(ar, "area", "left")
            .select(F.col("id").alias("artist_id"), F.col("gid").alias("artist_gid"),
                    F.col("name").alias("artist_name"), "artist_type", "area_name"))


def artist_training_features(cat, min_tag_count: int = 1, staging: str = "checkpoint") -> DataFrame:
    """Q1: full-catalogue artist features: one row per eligible artist with genre tokens.

    ``genres`` is the space-joined token string; ``tokens`` keeps the array form.
    Shared intermediates (U1, U4) are staged once, as the reference's temp tables.
    """
    n = check_min_count(min_tag_count)
    tg = training_pairs(cat, n, staging=staging)
    toks = genre_tokens(tg, "id", "genre", "tokens", listed_places(cat))
    meta = _artist_meta(cat, eligible_artists(cat["artist"]))
    out = (meta.join(toks.withColumnRenamed("id", "artist_id"), "artist_id")
           .where(F.size("tokens") > 0)                     # P3
           .select("artist_id", "artist_gid", "artist_name", "artist_type", "area_name",
                   F.lit("").alias("tags"),
                   F.array_join("tokens", " ").alias("genres"),
                   F.lit(0).cast("bigint").alias("tag_count_sum"),
                   "tokens"))
    return out


def artist_tag_rows(cat, min_tag_count: int = 1, max_artists: int | None = None) -> DataFrame:
    """J5 + J4: every eligible artist with its (tag, count, genre) rows; artists
    without a qualifying tag keep one row with null tag (left join, ON predicate)."""
    n = check_min_count(min_tag_count)
    art = eligible_artists(cat["artist"])
    if max_artists is not None:
        art = art.join(scope_entities(art.select("id"), max_artists), "id", "left_semi")
    meta = _artist_meta(cat, art)
    tags = (cat["artist_tag"].where(F.col("count") >= n)
            .select(F.col("artist").alias("artist_id"), F.col("tag").alias("tag_id"),
                    F.col("count").alias("tag_count")))
    tname = cat["tag"].select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    g = cat["genre"].select(F.lower("name").alias("_k"), F.col("name").alias("genre"))
    return (meta.join(tags, "artist_id", "left").join(tname, "tag_id", "left")
            .join(g, F.lower(F.col("tag")) == F.col("_k"), "left").drop("_k", "tag_id"))


def artist_rollup(rows: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """A10: group artist rows (null keys kept): ordered-unique tag string, tag-genre
    tokens and the sum of positive counts."""
    keys = ["artist_id", "artist_gid", "artist_name", "artist_type", "area_name"]
    tag_str = genre_tokens_text(rows.select("artist_id", F.col("tag").alias("v")), "tags", raw=True)
    tag_gen = genre_tokens(rows.select("artist_id", F.col("genre")).dropna(), "artist_id",
                           "genre", "tag_tokens", places)
    sums = rows.groupBy(*keys).agg(
        F.sum(F.greatest(F.coalesce(F.col("tag_count"), F.lit(0)), F.lit(0))).cast("bigint")
        .alias("tag_count_sum"))
    return (sums.join(tag_str, "artist_id", "left").join(tag_gen, "artist_id", "left")
            .select(*keys, F.coalesce("tags", F.lit("")).alias("tags"),
                    F.coalesce("tag_tokens", F.array().cast("array<string>")).alias("tag_tokens"),
                    "tag_count_sum"))


def genre_tokens_text(pairs: DataFrame, out: str, raw: bool = False) -> DataFrame:
    """X2 on raw strings: case-insensitive distinct values, first spelling in sorted
    order, space-joined (used for the ``tags`` column)."""
    v = strip("v")
    kept = (pairs.where(F.col("v").isNotNull() & (v != ""))
            .groupBy("artist_id", F.lower(v).alias("_k")).agg(F.min(v).alias("_s")))
    return kept.groupBy("artist_id").agg(
        F.array_join(F.array_sort(F.collect_list("_s")), " ").alias(out))


def artist_features_scoped(cat, min_tag_count: int = 1, max_artists: int | None = None,
                           skip_extended: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """Q2: tag rows + extended genres (U6) per artist; tokens = tag genres ++ extended.

    ``scope`` (a frame of artist ids, S3) or ``max_artists`` (S2) restrict the artists."""
    n = check_min_count(min_tag_count)
    rows = restrict(artist_tag_rows(cat, n, max_artists), scope, "artist_id")
    roll = artist_rollup(rows, listed_places(cat))
    if skip_extended:
        ext = None
    else:
        if max_artists or scope is not None:
            # scoped artists: release/RG genres plus recording genres for everyone
            scope = rows.select(F.col("artist_id").alias("id")).distinct()
            pairs = extended_genres(cat, n, scope)
        else:
            # whole catalogue: primary genres, recording genres only as fallback
            pairs = training_genres(cat, n)
        ext = genre_tokens(pairs, "id", "genre", "ext_tokens", listed_places(cat)).withColumnRenamed("id", "artist_id")
    if ext is not None:
        roll = roll.join(ext, "artist_id", "left")
        toks = F.concat("tag_tokens", F.coalesce("ext_tokens", F.array().cast("array<string>")))
    else:
        toks = F.col("tag_tokens")
    return (roll.withColumn("tokens", nonempty_tokens(toks))
            .where(F.size("tokens") > 0)
            .select("artist_id", "artist_gid", "artist_name", "artist_type", "area_name", "tags",
                    F.array_join("tokens", " ").alias("genres"), "tag_count_sum", "tokens"))


def slim(features: DataFrame) -> DataFrame:
    """P10: artist_id, artist_name, genres, first row per artist id."""
    return features.select("artist_id", "artist_name", "genres", "tokens").dropDuplicates(["artist_id"])


def weighted_tokens(cat, min_tag_count: int = 1, weights=(4, 3, 2, 1),
                    cap: int | None = None) -> DataFrame:
    """Tokens weighted by source (artist, RG, release, recording) -> (id, token, tf).

    ``cap`` keeps at most that many tokens per artist (alphabetical order).
    """
    from cadenza.operators.credits import (credited_recordings, credited_release_groups,
                                           credited_releases)
    n = check_min_count(min_tag_count)
    tg = tag_genre_ci(cat)
    crg = credited_release_groups(cat)
    crel = credited_releases(cat, crg=crg)
    crec = credited_recordings(cat)

    def part(ent, key, tags, tkey, w):
        t = tags.where(F.col("count") >= n).select(F.col(tkey).alias(key), "tag")
        return (ent.join(t, key).join(tg, "tag").select("id", "genre").distinct()
                .withColumn("w", F.lit(w)))
    a = (cat["artist_tag"].where(F.col("count") >= n).join(tg, "tag")
         .select(F.col("artist").alias("id"), "genre").distinct().withColumn("w", F.lit(weights[0])))
    parts = a.unionByName(part(crg, "release_group_id", cat["release_group_tag"], "release_group", weights[1])) \
        .unionByName(part(crel, "release_id", cat["release_tag"], "release", weights[2])) \
        .unionByName(part(crec, "recording_id", cat["recording_tag"], "recording", weights[3]))
    elig = eligible_artists(cat["artist"]).select("id")
    out = (parts.join(elig, "id", "left_semi").withColumn("token", genre_token("genre"))
           .where(F.col("token") != "")
           .groupBy("id", "token").agg(F.sum("w").cast("double").alias("tf")))
    if cap is not None:
        w = Window.partitionBy("id").orderBy("token")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return out
