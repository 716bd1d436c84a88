"""Registered album-side queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import albums, genres, imputers
from cadenza.plans.registry import catalog, query

ALBUM_SEEDS = [0, 6, 11]
ALBUM_BLACKLIST = [1]
ALBUM_TOP_N = 10
ALBUM_GENRES = list(range(1, 21))
ALBUM_ONE_GENRE = [5]


@query("q3_rg_features")
def q3(spark, sf):
    return albums.rg_features(catalog(spark, sf))


@query("a4_release_modes")
def a4(spark, sf):
    return genres.release_modes(catalog(spark, sf))


@query("a5_secondary_types")
def a5(spark, sf):
    return genres.secondary_types(catalog(spark, sf))


@query("w1_original_edition")
def w1(spark, sf):
    return albums.original_edition(catalog(spark, sf))


@query("a7_release_stats")
def a7(spark, sf):
    return albums.release_stats(catalog(spark, sf))


@query("a8_rg_length")
def a8(spark, sf):
    return albums.rg_length(catalog(spark, sf))


@query("a9_rg_artists")
def a9(spark, sf):
    return albums.rg_artist_names(albums.rg_artists(catalog(spark, sf)))


@query("k7_backfill_genres")
def k7(spark, sf):
    cat = catalog(spark, sf)
    return imputers.backfill_genres(albums.rg_features(cat), cat).select("id", "tag_ids", "genre_ids")


@query("k10_infer_types")
def k10(spark, sf):
    cat = catalog(spark, sf)
    return imputers.infer_types(albums.rg_features(cat), cat).select("id", "type")


@query("k11_imputer_stats")
def k11(spark, sf):
    return albums.fit_imputers(albums.rg_features(catalog(spark, sf)))


_MODELS: dict = {}


def album_model(spark, sf, **stages):
    key = (spark.sparkContext.applicationId, sf, tuple(sorted(stages.items())))
    if key not in _MODELS:
        _MODELS[key] = albums.build_album_model(catalog(spark, sf), **stages)
    return _MODELS[key]


@query("k5_album_knn")
def k5(spark, sf):
    m = album_model(spark, sf)
    r = albums.recommend_albums(m, ALBUM_SEEDS, ALBUM_TOP_N, ALBUM_BLACKLIST, unknown="skip")
    return r.select("rank", "id", F.round("distance", 12).alias("distance"))


@query("k5_album_knn_genre_filter")
def k5g(spark, sf):
    m = album_model(spark, sf)
    r = albums.recommend_albums(m, ALBUM_SEEDS, ALBUM_TOP_N, ALBUM_BLACKLIST, genre_ids=ALBUM_GENRES,
                                unknown="skip")
    return r.select("rank", "id", F.round("distance", 12).alias("distance"))


@query("k5_album_knn_one_genre")
def k5g1(spark, sf):
    """One rare genre: the filter comes before the top-k, so no row is lost to a window."""
    r = albums.recommend_albums(album_model(spark, sf), ALBUM_SEEDS, ALBUM_TOP_N, ALBUM_BLACKLIST,
                                genre_ids=ALBUM_ONE_GENRE, unknown="skip")
    return r.select("rank", "id", F.round("distance", 12).alias("distance"))


@query("q8_album_recommendations")
def q8(spark, sf):
    cat = catalog(spark, sf)
    m = album_model(spark, sf)
    r = albums.recommend_albums(m, ALBUM_SEEDS, ALBUM_TOP_N, ALBUM_BLACKLIST, unknown="skip")
    e = albums.enrich_albums(cat, r)
    return e.select("rank", "id", "gid", "title", "artist", "genres", "tracks", "length",
                    F.round("distance", 12).alias("distance"))


@query("q5_album_model_data")
def q5(spark, sf):
    """Q5: the staged album model data (backfill, language, types all switched on)."""
    m = album_model(spark, sf)
    return m.data


@query("k6_album_neighbours_all")
def k6(spark, sf):
    """K6: for every release group its 5 nearest (itself removed -> at most 4 rows)."""
    m = album_model(spark, sf)
    req = m.data.select(F.col("id").alias("query_id"), F.lit(5).alias("top_n"))
    r = albums.album_neighbours(m, req)
    # no negative zero: equal vectors can be at -1e-16
    return r.select("query_id", "rank", "id", (F.round("distance", 12) + F.lit(0.0)).alias("distance"))


@query("k12_label_vocabulary")
def k12(spark, sf):
    return albums.label_vocabulary(albums.rg_features(catalog(spark, sf)))


# ----------------------------------------------------------------- K9, K8
from cadenza.operators import langid  # noqa: E402
from cadenza.session import stage  # noqa: E402


@query("k9_detect_documents")
def k9(spark, sf):
    docs = catalog(spark, sf)["documents"]
    model = langid.train_langid(docs)
    return langid.detect_language(docs.select(F.col("doc_id").alias("id"), "text"), model) \
        .withColumnRenamed("id", "doc_id")


@query("k9_langid_accuracy")
def k9_acc(spark, sf):
    """Five-fold cross-validated accuracy over every document."""
    return langid.crossval_accuracy(catalog(spark, sf)["documents"])


@query("k8_infer_language")
def k8(spark, sf):
    cat = catalog(spark, sf)
    model = stage(langid.train_langid(cat["documents"]))      # fitted once, lineage cut
    return langid.infer_language(albums.rg_features(cat), cat, model).select("id", "language", "script")
