"""Hand-written edge frames (FIXTURES.md section 3): editions, TF-IDF, language stage, filters."""

import math

from pyspark.sql import functions as F

from cadenza.operators import albums, langid
from cadenza.operators.knn import tfidf
from cadenza.sources.catalog import Catalog


def cat_of(spark, tables):
    return Catalog(spark, {k: (lambda c, v=v: v) for k, v in tables.items()})


def test_original_edition_rules(spark):
    rel = spark.createDataFrame([
        # rg 1: all dates null -> lowest non-special id
        (11, 1, "Album"), (12, 1, "Album"), (10, 1, "Album (Deluxe)"),
        # rg 2: only a deluxe edition
        (20, 2, "Album Super Deluxe"),
        # rg 3: release 31 has two country dates, the earliest (1990) beats 32 (1991)
        (31, 3, "A"), (32, 3, "A"),
        # rg 4: equal dates -> lower id; unknown-country date used only without a country date
        (42, 4, "A"), (41, 4, "A"), (43, 4, "A")],
        "id long, release_group long, name string")
    rc = spark.createDataFrame([(31, 1995, 1, 1), (31, 1990, 5, 5), (32, 1991, 1, 1),
                                (41, 2000, 1, 1), (42, 2000, 1, 1)],
                               "release long, date_year int, date_month int, date_day int")
    ruc = spark.createDataFrame([(43, 1999, None, None), (41, 1980, 1, 1)],
                                "release long, date_year int, date_month int, date_day int")
    cat = cat_of(spark, {"release": rel, "release_country": rc, "release_unknown_country": ruc})
    got = {r[0]: r[1] for r in albums.original_edition(cat).collect()}
    assert got == {1: 11, 2: 20, 3: 31, 4: 43}


def test_tfidf_edges(spark):
    docs = spark.createDataFrame([(1, ["rock", "pop", "pop"]), (2, ["rock"]), (3, ["rock", "jazz"])],
                                 "artist_id long, tokens array<string>")
    vocab, vec = tfidf(docs)
    idf = {r["token"]: r["idf"] for r in vocab.collect()}
    assert idf["rock"] == 1.0                                    # in every document
    assert abs(idf["pop"] - (math.log(4 / 2) + 1)) < 1e-12
    w = {(r[0], r[1]): r[2] for r in vec.collect()}
    assert abs(w[(2, "rock")] - 1.0) < 1e-12                   # one token -> unit weight
    p = 2 * idf["pop"]
    assert abs(w[(1, "pop")] - p / math.sqrt(p * p + 1)) < 1e-12   # tf 2


def test_language_stage_overwrites_both_and_whitelists(spark):
    df = spark.createDataFrame([(1, 145, None), (2, 9999, 28), (3, 120, 28), (4, None, 999)],
                               "id long, language int, script int")
    rg = spark.createDataFrame([(1, "the and of the"), (2, "x"), (3, "y"), (4, "el la de los")],
                               "id long, name string")
    empty = spark.createDataFrame([], "id long, release long, name string")
    cat = cat_of(spark, {
        "release_group": rg,
        "release": spark.createDataFrame([], "id long, release_group long"),
        "medium": spark.createDataFrame([], "id long, release long"),
        "track": empty.select("id", F.col("release").alias("medium"), "name")})
    docs = spark.createDataFrame([("en", "the cat and the dog of the house and the garden"),
                                  ("es", "el perro y la casa de los amigos con el gato")],
                                 "lang string, text string")
    model = langid.train_langid(docs)
    got = {r[0]: (r[1], r[2]) for r in langid.infer_language(df, cat, model).collect()}
    assert got[1] == (120, 28)          # language known, script missing -> both from detection
    assert got[2] == (None, 28)         # 9999 is not a known language id -> null; script kept
    assert got[3] == (120, 28)
    assert got[4] == (393, 28)          # detected Spanish


def test_album_filters(spark):
    from cadenza.plans.album_queries import album_model
    from conftest import SF_SMALL
    m = album_model(spark, SF_SMALL)
    a = albums.recommend_albums(m, [0, 6], 5, blacklist=None).collect()
    b = albums.recommend_albums(m, [0, 6], 5, blacklist=[]).collect()
    c = albums.recommend_albums(m, [0, 6], 5, blacklist=[0], genre_ids=[]).collect()   # seed in blacklist
    assert [tuple(r) for r in a] == [tuple(r) for r in b] == [tuple(r) for r in c]
    assert all(r["id"] not in (0, 6) for r in a)


def test_one_genre_returns_top_n_whenever_that_many_exist(spark):
    """No window before the filter; and a batch gives what single requests give."""
    from cadenza.plans.album_queries import album_model
    from conftest import SF_SMALL
    m = album_model(spark, SF_SMALL)
    rows = m.data.select("id", "genre_ids").collect()
    genres = sorted({g for r in rows for g in r["genre_ids"] or []})[:6]
    req = spark.createDataFrame(
        [(g, [0, 6, 11], [1], 10, [g]) for g in genres] + [(1000, [0], None, 4, None)],
        "request_id long, seeds array<long>, blacklist array<long>, top_n int, genre_ids array<int>")
    batch = albums.recommend_albums_batch(m, req).collect()
    for g in genres:
        one = albums.recommend_albums(m, [0, 6, 11], 10, [1], genre_ids=[g]).collect()
        exist = sum(g in (r["genre_ids"] or []) and r["id"] not in (0, 1, 6, 11) for r in rows)
        assert len(one) == min(10, exist)
        assert sorted((r["rank"], r["id"]) for r in one) == sorted(
            (r["rank"], r["id"]) for r in batch if r["request_id"] == g)
    one = albums.recommend_albums(m, [0], 4).collect()
    assert sorted((r["rank"], r["id"]) for r in one) == sorted(
        (r["rank"], r["id"]) for r in batch if r["request_id"] == 1000)


def test_stage_needs_a_shared_folder_on_a_cluster():
    import pytest
    from cadenza.session import require_local_master
    require_local_master("local")
    require_local_master("local[8]")
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            require_local_master(master)


def test_language_scores_are_the_same_by_broadcast_and_by_counts(spark, monkeypatch):
    """Occurrences beside a model that travels, and counted grams beside a large model."""
    docs = spark.createDataFrame(
        [(i, lang, f"{text} {text[::2]} {i % 3}") for i, (lang, text) in enumerate(
            [("en", "the cat and the dog"), ("de", "der Hund und die Katze"), ("fr", "le chien et le chat"),
             (None, "no label here")] * 6)] + [(100, "en", None), (101, "de", "  "), (None, "en", "the dog")],
        "doc_id long, lang string, text string")

    def results():
        model = langid.train_langid(docs)
        found = langid.detect_language(docs.select(F.col("doc_id").alias("id"), "text"), model)
        return (sorted(map(tuple, found.collect()), key=repr),
                sorted(map(tuple, langid.crossval_accuracy(docs).collect()), key=repr))

    near = results()
    monkeypatch.setattr(langid, "BROADCAST_GRAMS", 0)
    assert near == results()
    assert {x for _, x in near[0]} >= {"en", "de", "fr"}


def test_genres_of_tags_are_written_once_for_a_catalogue(spark):
    from cadenza.operators.genres import tag_genre_ci
    from cadenza.session import Stages
    cat = cat_of(spark, {"tag": spark.createDataFrame([(1, "Rock"), (2, "red")], "id int, name string"),
                         "genre": spark.createDataFrame([(1, "rock")], "id int, name string")})
    with Stages() as scratch:
        first = tag_genre_ci(cat)
        scratch.release()                          # it outlasts the scope it was written in
    assert tag_genre_ci(cat) is first and [tuple(r) for r in first.collect()] == [(1, "rock")]
