"""Edge frames for the scalar functions (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from cadenza.functions import scalars as X


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_genre_token(spark):
    out = one(spark, X.genre_token("s"), [("Électro-Pop / R&B!",), ("  ",), (None,), ("!!!",),
                                         ("Hip Hop",), ("hip-hop",)], "s string")
    assert out == ["électro_pop_r_b", "", None, "", "hip_hop", "hip_hop"]


def test_genre_tokens_first_spelling_and_tf(spark):
    from cadenza.operators.genres import genre_tokens
    df = spark.createDataFrame([(1, "Hip Hop"), (1, "hip hop"), (1, "hip-hop"), (1, "  "), (1, None)],
                               "id long, genre string")
    toks = genre_tokens(df).collect()[0]["tokens"]
    # 'Hip Hop' and 'hip hop' are one genre; 'hip-hop' is another spelling -> tf 2
    assert sorted(toks) == ["hip_hop", "hip_hop"]


def test_classify_type(spark):
    rows = [(9, 1000), (8, 30 * 60000), (8, 30 * 60000 + 1), (1, 7 * 60000 - 1), (1, 7 * 60000), (2, None)]
    out = one(spark, X.classify_type("t", "ms"), rows, "t int, ms long")
    assert out == [1, 3, 1, 2, 3, None]


def test_formats(spark):
    rows = [(0,), (59 * 60000,), (60 * 60000,), (61 * 60000,), (None,)]
    assert one(spark, X.format_duration_ms("ms"), rows, "ms long") == ["0 min", "59 min", "1h", "1h 1 min", ""]
    assert one(spark, X.format_tracks("n"), [(1,), (0,), (None,), (7,)], "n int") == \
        ["1 track", "0 tracks", "", "7 tracks"]


def test_ui_duration(spark):
    rows = [("9999",), ("10000",), ("3600",), ("-1",), ("abc",), ("7261",)]
    assert one(spark, X.ui_duration("v"), rows, "v string") == \
        ["2h 46 min", "10 sec", "1h 0 min", None, None, "2h 1 min"]


def test_capitalize_first_not_initcap(spark):
    assert one(spark, X.capitalize_first("s"), [("hIP hop",)], "s string") == ["Hip hop"]


def test_mode_ties_and_bround(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (1, 2), (2, None)], "g int, v int")
    got = {r[0]: r[1] for r in df.groupBy("g").agg(F.mode("v", deterministic=True)).collect()}
    assert got == {1: 2, 2: None}
    y = spark.createDataFrame([(1998.5,), (1999.5,)], "y double").select(F.bround("y", 0)).collect()
    assert [r[0] for r in y] == [1998.0, 2000.0]


def test_jaccard_and_official_site(spark):
    df = spark.createDataFrame([([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert abs(df.select(X.jaccard("a", "b")).first()[0] - 1 / 3) < 1e-12
    u = spark.createDataFrame([([("x", 179), ("y", 183), ("z", 183)],)],
                              "u array<struct<url:string,type:int>>")
    assert u.select(X.official_site("u")).first()[0] == "y"


def test_normalize_lang(spark):
    rows = [("iw", "shalom"), ("ru", "privet"), ("ru", "привет"), ("tl", "x")]
    assert one(spark, X.normalize_lang("c", "t"), rows, "c string, t string") == ["he", "ru-Latn", "ru", "fil"]


def test_word_class_strip_and_bounds(spark):
    from cadenza.functions import scalars as X
    df = spark.createDataFrame([("cafe\u0301 noir",), ("m\u00b2 rock",), ("a\u203fb",), ("\t\u00a0x y\u3000",)],
                               "s string")
    got = [r[0] for r in df.select(X.genre_token("s")).collect()]
    assert got == ["cafe_noir", "m\u00b2_rock", "a_b", "x_y"]
    num = spark.createDataFrame([(1e10,), (float("inf"),), (float("-inf"),), (float("nan"),), (7.9,)],
                                "x double")
    assert [r[0] for r in num.select(X.clamp_int("x", 1, 50)).collect()] == [50, 1, 1, 1, 7]
    assert [r[0] for r in num.select(X.ui_duration("x")).collect()][1:4] == [None] * 3
    one = spark.createDataFrame([(30, 10, "g", ["a", None, "b", "c"])],
                                "m int, n int, gid string, g array<string>")
    r = one.select(X.ordered_min_listen("m", "n"), X.artist_link("gid"), X.genre_list("g"),
                   X.genre_list("g", 2), X.artist_link(F.lit(None).cast("string"))).first()
    assert tuple(r) == (10, X.ARTIST_PAGE + "g", "a, b, c", "a, b", None)
