"""Registered search, listening-profile, evaluation and display queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scalars as X
from cadenza.functions.numbering import dense_numbers
from cadenza.operators import albums, metrics, profile, search
from cadenza.operators.recommend import recommend_artists_batch, with_cards, with_outcome
from cadenza.plans.artist_queries import _model
from cadenza.plans.registry import catalog, query

PROFILE_RANGE, PROFILE_MIN = "this_month", 1
BLACKLIST_RANGE, BLACKLIST_MIN = "week", 2
MAX_RESULTS = 10


@query("p7_search_artists")
def p7(spark, sf):
    return search.search_artists(catalog(spark, sf), "00001")


@query("p8_search_genres")
def p8(spark, sf):
    return search.search_genres(catalog(spark, sf), "blue")


@query("j1_search_albums")
def j1(spark, sf):
    return search.search_albums(catalog(spark, sf), "urgent")


@query("p9_listened_artist_gids")
def p9(spark, sf):
    cat = catalog(spark, sf)
    gids = cat["listens"].select(F.concat(F.lit("gid-"), F.col("artist").cast("string")).alias("gid")).distinct()
    return search.artist_ids_for_gids(cat, gids)


@query("q12_top_listened")
def q12(spark, sf):
    cat = catalog(spark, sf)
    t = profile.top_listened(cat["listens"], PROFILE_RANGE, PROFILE_MIN)
    return t.join(cat["artist"].select(F.col("id").alias("artist"), F.col("gid").alias("artist_mbid")),
                  "artist", "left").select("user_id", "artist", "artist_mbid", "listen_count")


@query("q12_top_listened_all_ranges")
def q12r(spark, sf):
    cat = catalog(spark, sf)
    lis = cat["listens"]
    now = profile.as_of(lis)
    out = None
    for r in profile.RANGES:
        t = profile.top_listened(lis, r, 0, now).withColumn("range", F.lit(r))
        out = t if out is None else out.unionByName(t)
    return out


@query("q9_profile_artist_recs")
def q9(spark, sf):
    cat = catalog(spark, sf)
    req = profile.profile_requests(cat, cat["listens"], PROFILE_RANGE, PROFILE_MIN,
                                   BLACKLIST_RANGE, BLACKLIST_MIN, MAX_RESULTS)
    m = _model(spark, sf)
    e = with_cards(m, recommend_artists_batch(m, req))
    out = with_outcome(e, req, m.features, "artist_id")
    return out.select(F.col("request_id").alias("user_id"), "status", "rank", "artist_id", "gid",
                      "name", "genres", F.round("distance", 6).alias("distance"))


@query("q11_evaluation_report")
def q11(spark, sf):
    m = _model(spark, sf)
    return metrics.evaluation_report(m.features.drop("tokens"), m.vocab, m.vectors, None, 5,
                                     index=m.index()).drop("run_id")


@query("x_rg_display")
def x_rg_display(spark, sf):
    rl = albums.rg_length(catalog(spark, sf))
    return rl.select("release_group", "tracks", "length",
                     X.format_tracks("tracks").alias("tracks_text"),
                     X.format_duration_ms("length").alias("duration_text"),
                     X.ui_duration("length").alias("ui_duration"),
                     X.classify_type("tracks", "length").alias("type_class"),
                     X.display_details("length", "tracks").alias("details"))


@query("x_artist_labels")
def x_artist_labels(spark, sf):
    a = catalog(spark, sf)["artist"]
    return a.select("id", X.display_name("name", "comment").alias("label"),
                    X.capitalize_first("name").alias("capitalized"),
                    X.genre_token("name").alias("token"),
                    X.special_edition("name").alias("edition_flag"))


@query("x_album_labels")
def x_album_labels(spark, sf):
    cat = catalog(spark, sf)
    names = albums.rg_artist_names(albums.rg_artists(cat)).withColumnRenamed("release_group", "id")
    rg = cat["release_group"].join(names, "id", "left")
    return rg.select("id", X.display_title("name", "artist").alias("label"),
                     X.clamp_int(F.col("id") / 1000, 1, 50).alias("clamped"))


# ----------------------------------------------------------------- digests, slim data
from cadenza.operators.artists import slim  # noqa: E402
from cadenza.operators.digest import album_digest  # noqa: E402
from cadenza.operators.recommend import artist_digest  # noqa: E402
from cadenza.plans.album_queries import ALBUM_SEEDS, ALBUM_TOP_N, ALBUM_BLACKLIST, album_model  # noqa: E402


@query("s9_profile_artist_digests")
def s9(spark, sf):
    """One markdown digest per user from the profile recommendations (Q9)."""
    cat = catalog(spark, sf)
    req = profile.profile_requests(cat, cat["listens"], PROFILE_RANGE, PROFILE_MIN,
                                   BLACKLIST_RANGE, BLACKLIST_MIN, MAX_RESULTS)
    m = _model(spark, sf)
    e = with_cards(m, recommend_artists_batch(m, req))
    return artist_digest(e).withColumnRenamed("request_id", "user_id")


@query("s10_album_digest")
def s10(spark, sf):
    cat = catalog(spark, sf)
    r = albums.recommend_albums(album_model(spark, sf), ALBUM_SEEDS, ALBUM_TOP_N, ALBUM_BLACKLIST, unknown="skip")
    return album_digest(albums.enrich_albums(cat, r))


@query("p10_slim_artist_data")
def p10(spark, sf):
    return slim(_model(spark, sf).features).drop("tokens")


@query("p9_release_gids_to_release_groups")
def p9r(spark, sf):
    cat = catalog(spark, sf)
    return search.release_group_ids_for_release_gids(cat, cat["release"].select("gid"))


@query("q10_profile_album_recs")
def q10(spark, sf):
    cat = catalog(spark, sf)
    req = profile.profile_album_requests(cat, cat["listens"], PROFILE_RANGE, PROFILE_MIN,
                                         BLACKLIST_RANGE, BLACKLIST_MIN, MAX_RESULTS)
    m = album_model(spark, sf)
    e = albums.enrich_albums(cat, albums.recommend_albums_batch(m, req))
    out = with_outcome(e, req, m.data, "id")
    return out.select(F.col("request_id").alias("user_id"), "status", "rank", "id", "gid", "title",
                      "artist", F.round("distance", 12).alias("distance"))


@query("q10_release_album_recs")
def q10_releases(spark, sf):
    """Q10 by its own chain: listened release gids -> release groups (P9) -> album requests."""
    cat = catalog(spark, sf)
    req = profile.release_requests(cat, cat["release_listens"], "all_time", 0, "this_week", 0,
                                   MAX_RESULTS)
    m = album_model(spark, sf)
    out = with_outcome(albums.recommend_albums_batch(m, req), req, m.data, "id")
    return out.select(F.col("request_id").alias("user_id"), "status", "rank", "id",
                      F.round("distance", 12).alias("distance"))


@query("s8_listen_stats_seeds")
def s8(spark, sf):
    """S8 -> P9 -> Q9's requests: statistics written as JSON, one document a user, read back."""
    cat = catalog(spark, sf)
    top = profile.top_listened(cat["listens"], PROFILE_RANGE, 0).join(
        cat["artist"].select(F.col("id").alias("artist"), F.col("gid").alias("artist_mbid")), "artist")
    path = staging_path(spark, "listen-stats")
    profile.write_listen_stats(top, path, "artists", "artist_mbid", "artist_mbid")
    stats = profile.read_listen_stats(spark, path, "artists", PROFILE_MIN, multi_line=False)
    req = profile.stats_requests(cat, stats, MAX_RESULTS)
    return req.select(F.col("request_id").alias("user_id"), "seeds", "top_n")


# ----------------------------------------------------------------- stores as round trips
from cadenza.operators.recommend import recommend_artists  # noqa: E402
from cadenza.plans.artist_queries import Q1_COLS  # noqa: E402
from cadenza.plans.registry import BLACKLIST, SEEDS, TOP_N  # noqa: E402
from cadenza.session import staging_path  # noqa: E402
from cadenza.sources import store  # noqa: E402


@query("s4_cached_features")
def s4(spark, sf):
    """Features written under their build parameters, then served from there."""
    path, key = staging_path(spark, "cache"), {"min_tag_count": 1}
    store.cached_features(spark, path, key, lambda: _model(spark, sf).features.select(*Q1_COLS))
    return store.cached_features(spark, path, key, lambda: None)


@query("s6_loaded_artist_model")
def s6_artists(spark, sf):
    """S5 + S6: one request served by a saved and loaded artist model."""
    m, _ = store.load_model(spark, store.save_model(_model(spark, sf), staging_path(spark, "model")))
    r = recommend_artists(m, SEEDS, TOP_N, BLACKLIST, filter_recommendable=False)
    return r.select("rank", "artist_id", F.round("distance", 6).alias("distance"), "status")


@query("s6_loaded_album_model")
def s6_albums(spark, sf):
    """S5 + S6: one request served by a saved and loaded album model."""
    m, _ = store.load_model(spark, store.save_model(album_model(spark, sf), staging_path(spark, "model")))
    r = albums.recommend_albums(m, ALBUM_SEEDS, ALBUM_TOP_N, ALBUM_BLACKLIST, unknown="skip")
    return r.select("rank", "id", F.round("distance", 12).alias("distance"))


@query("s7_metrics_table")
def s7(spark, sf):
    """Two runs, then one of them again: each read, upserted and written on one path."""
    row = metrics.data_metrics(_model(spark, sf).features, _model(spark, sf).vocab)
    path = staging_path(spark, "metrics")
    for run, rows in (("a", F.col("data_rows")), ("b", F.lit(0).cast("long")), ("b", F.col("data_rows"))):
        store.update_metrics(spark, path, row.withColumn("run_id", F.lit(run)).withColumn("data_rows", rows))
    return store.read_metrics(spark, path).select("run_id", "data_rows", "vocab_size")


@query("x_artist_text")
def x_artist_text(spark, sf):
    """X4, X5, X22 over artist names."""
    a = catalog(spark, sf)["artist"]
    return a.select("id", X.normalize_ws(F.concat(F.lit("  "), F.col("name"), F.lit(" \t x "))).alias("spaced"),
                    X.word_tokens("name").alias("words"), X.artist_link("gid").alias("link"))


@query("w5_seeded_shuffle")
def w5(spark, sf):
    """Every genre with the key that its seeded shuffle orders by."""
    from cadenza.operators.digest import seeded_shuffle, shuffle_key
    g = seeded_shuffle(catalog(spark, sf)["genre"].select("id", "name"), "id")
    return g.select("id", "name", shuffle_key(F.col("id")).alias("key"))


@query("j10_ordered_ids")
def j10(spark, sf):
    """J10 + Q6: an ordered id list (most listened artists first) with ranks, filtered in order."""
    from cadenza.operators.recommend import filter_recommendable_ordered
    cat = catalog(spark, sf)
    n = cat["listens"].where(F.col("artist").isNotNull()).groupBy(F.col("artist").alias("id")).agg(
        F.count(F.lit(1)).alias("n"))
    ranked = dense_numbers(n, [F.desc("n"), "id"], "rank", start=1).withColumn("rank", F.col("rank").cast("int"))
    return filter_recommendable_ordered(cat, ranked.select("rank", "id")).select("rank", "id")


@query("x_user_settings")
def x_user_settings(spark, sf):
    """Each user's settings (listens as the minimum asked for, distinct artists as the
    results), and the genres of their artists as a list."""
    cat = catalog(spark, sf)
    g = (cat["listens"].select("user_id", "artist").distinct().join(cat["artist_tag"], "artist")
         .join(cat["tag"].select(F.col("id").alias("tag"), "name"), "tag")
         .groupBy("user_id").agg(F.array_sort(F.collect_set("name")).alias("genres")))
    per = cat["listens"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"),
                                                F.count_distinct("artist").alias("artists"))
    top = X.clamp_int("artists", 1, 50)
    return per.join(g, "user_id", "left").select(
        "user_id", top.alias("max_results"), X.ordered_min_listen("n", top).alias("min_listen"),
        X.genre_list("genres", 10).alias("genres"), X.genre_list("genres").alias("all_genres"))
