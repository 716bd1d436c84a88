"""Release-group (album) features, imputation, vectors, recommendation, enrichment.

Q3, A4-A9, A15, A20, K2, K5, K6, K10, K11, K12, W1, J6, J9, J13, Q8.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbering import dense_numbers
from cadenza.functions.scalars import as_int_list, special_edition
from cadenza.operators.genres import release_modes, rg_tag_buckets, secondary_types
from cadenza.operators.knn import knn_single, missing_seeds, terms_of
from cadenza.operators.nearest import BoxIndex, box_index, search
from cadenza.operators.recommend import local_rows, valid_requests, validate_request
from cadenza.session import Stages, stage

ALBUM_RANK_DIGITS = 12   # album distances are tiny (raw ids and years dominate)
CATEGORICAL = ["type", "status", "language", "script"]
NUMERIC = ["year"]
LISTS = ["tag_ids", "genre_ids", "secondary_type_ids"]
LIST_PREFIX = {"tag_ids": "t", "genre_ids": "g", "secondary_type_ids": "s"}
SCALARS = CATEGORICAL + NUMERIC


def rg_features(cat) -> DataFrame:
    """Q3: one row per release group with type, year, label arrays and release modes."""
    tags, genres = rg_tag_buckets(cat)
    meta = cat["release_group_meta"].select(F.col("id"), F.col("first_release_date_year").alias("year"))
    modes = release_modes(cat).withColumnRenamed("release_group", "id")
    sec = secondary_types(cat).withColumnRenamed("release_group", "id")
    rg = cat["release_group"].select("id", F.col("type").cast("int").alias("type"))
    return (rg.join(meta, "id", "left")
            .join(tags.withColumnRenamed("release_group", "id"), "id", "left")
            .join(genres.withColumnRenamed("release_group", "id"), "id", "left")
            .join(modes, "id", "left")
            .join(sec, "id", "left")
            .select("id", "type", F.col("year").cast("int").alias("year"),
                    as_int_list("tag_ids").alias("tag_ids"), as_int_list("genre_ids").alias("genre_ids"),
                    F.col("status").cast("int").alias("status"),
                    F.col("language").cast("int").alias("language"),
                    F.col("script").cast("int").alias("script"),
                    as_int_list("secondary_type_ids").alias("secondary_type_ids")))


# ---------------------------------------------------------------- imputation

def fit_imputers(df: DataFrame) -> DataFrame:
    """One row: most frequent value per categorical column (ties -> lowest),
    mean of the numeric column, rounded to float32 as the vectoriser stores it."""
    aggs = [F.mode(c, deterministic=True).cast("double").alias(c) for c in CATEGORICAL]
    aggs += [F.avg(c).cast("float").cast("double").alias(c) for c in NUMERIC]
    return df.agg(*aggs)


def impute(df: DataFrame, stats_row) -> DataFrame:
    """Fill nulls from the fitted statistics (a single small row)."""
    out = df
    for c in SCALARS:
        v = stats_row[c]
        filled = F.col(c).cast("float").cast("double")
        out = out.withColumn(c, F.coalesce(filled, F.lit(v).cast("double")) if v is not None else filled)
    return out


# ---------------------------------------------------------------- vectors

def album_vectors(df: DataFrame) -> DataFrame:
    """K2: long-form vector (id, token, w): five scalar dims + multi-hot label dims."""
    scal = df.select("id", F.explode(F.array(*[
        F.struct(F.lit(str(i)).alias("token"), F.col(c).alias("w")) for i, c in enumerate(SCALARS)
    ])).alias("e")).select("id", "e.token", "e.w").where(F.col("w").isNotNull() & (F.col("w") != 0))
    parts = [scal]
    for c in LISTS:
        parts.append(df.select("id", F.explode(F.array_distinct(c)).alias("v"))
                     .select("id", F.concat(F.lit(LIST_PREFIX[c] + ":"), F.col("v").cast("string"))
                             .alias("token"), F.lit(1.0).alias("w")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_vocabulary(df: DataFrame) -> DataFrame:
    """Sorted distinct labels per list column with their column index."""
    parts = [df.select(F.lit(c).alias("column"), F.explode(c).alias("label")) for c in LISTS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    out = dense_numbers(out, ["column", "label"], "_place")
    first = out.groupBy("column").agg(F.min("_place").alias("_start"))    # a row per list column
    return out.join(first, "column").select("column", "label",
                                            (F.col("_place") - F.col("_start")).cast("int").alias("index"))


@dataclass
class AlbumModel:
    data: DataFrame       # transformed rows before imputation (Q3 after stages)
    stats: object         # fitted imputation row
    vectors: DataFrame    # (id, token, w) after imputation
    terms: DataFrame      # (id, terms, norm, genre_ids), one row per release group
    _index: BoxIndex | None = None

    def index(self) -> BoxIndex:
        """The index of tables of requests, built when first used: the year dominates a vector,
        the other scalar components (language first) tell most distances."""
        if self._index is None:
            c = self.vectors.select(F.col("id").alias("cand_id"), F.col("token").alias("key"), "w")
            year = str(SCALARS.index("year"))
            box = [str(SCALARS.index(x)) for x in ("language", "script", "type", "status")]
            self._index = box_index(c, year, box, coarse=[box[:2], box[:1]])
        return self._index


def build_album_model(cat, features: DataFrame | None = None, staging: str = "checkpoint",
                      backfill: bool = True, language: bool = True, types: bool = True,
                      lang_model: DataFrame | None = None) -> AlbumModel:
    """Features -> stages (K7 backfill, K8 language, K10 types; each can be switched
    off) -> imputers -> vectors; each stage is fitted once and its lineage cut."""
    from cadenza.operators.imputers import backfill_genres, infer_types
    from cadenza.operators.langid import infer_language, train_langid
    with Stages() as scratch:
        df = features if features is not None else rg_features(cat)
        df = stage(df, staging)
        if backfill:
            df = stage(backfill_genres(df, cat), staging)
        if language:
            lm = lang_model if lang_model is not None else stage(train_langid(cat["documents"]), staging)
            df = stage(infer_language(df, cat, lm), staging)
        if types:
            df = stage(infer_types(df, cat), staging)
        stats = fit_imputers(df).first()      # one row of five numbers
        vec = stage(album_vectors(impute(df, stats)), staging)
        terms = stage(terms_of(vec, "id").join(df.select("id", "genre_ids"), "id"), staging)
        scratch.release(df, vec, terms)     # what is left on disk is the model
    return AlbumModel(df, stats, vec, terms)


# ---------------------------------------------------------------- A15 seed profile

def seed_profile(data: DataFrame, seeds) -> DataFrame:
    """One-row profile of a seed set (modes, sorted label union, half-even mean year)."""
    s = data.where(F.col("id").isin([int(x) for x in seeds]))
    aggs = [F.mode(c, deterministic=True).alias(c) for c in CATEGORICAL]
    aggs.append(F.bround(F.avg("year"), 0).cast("int").alias("year"))
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in LISTS]
    return s.agg(*aggs).withColumn("id", F.lit(-1).cast("long"))


def recommend_albums(model: AlbumModel, seeds, top_n: int = 10, blacklist=None,
                     genre_ids=None, unknown: str = "raise") -> DataFrame:
    """K5 + P4 + P5: albums near one seed-set profile -> (rank, id, distance).

    Exclusions and the genre filter come before an exact top-k: ``top_n`` rows come back
    whenever that many albums qualify.  Unknown seeds raise (P11), or, with ``unknown="skip"``, leave
    the profile to the seeds that are known (none: every album is at distance 1).
    """
    if unknown not in ("raise", "skip"):
        raise ValueError(f"unknown must be 'raise' or 'skip', not {unknown!r}")
    validate_request(seeds, top_n)
    seeds = sorted({int(s) for s in seeds})
    known = model.data.where(F.col("id").isin(seeds))
    missing = sorted(set(seeds) - {r[0] for r in known.select("id").collect()})   # seeds only
    if missing and unknown == "raise":
        raise LookupError(f"unknown release group ids: {missing}")
    prof = impute(seed_profile(model.data, seeds), model.stats)
    # one request's labels
    cen = {} if len(missing) == len(seeds) else {
        r["token"]: r["w"] for r in album_vectors(prof).select("token", "w").collect()}
    where = None
    if genre_ids:
        where = F.arrays_overlap("genre_ids", F.array(*[F.lit(int(x)) for x in genre_ids]))
    top = knn_single(model.terms, cen, top_n, key="id", where=where, digits=ALBUM_RANK_DIGITS,
                     exclude=set(seeds) | {int(b) for b in blacklist or []})
    # at most top_n rows, read several times by enrichment: a local table
    rows = [(r["rank"], r["id"], r["distance"]) for r in top.collect()]     # top_n at most
    return local_rows(model.terms.sparkSession, rows, "id", top_n).drop("status")


def album_neighbours(model: AlbumModel, requests: DataFrame, exclude_seed: bool = True) -> DataFrame:
    """K6: per seed RG its ``top_n`` nearest (itself included, removed afterwards,
    so at most top_n - 1 rows) -> (query_id, rank, id, distance)."""
    q = model.vectors.join(requests.select(F.col("query_id").alias("id"), "top_n"), "id") \
        .select(F.col("id").alias("query_id"), F.col("token").alias("key"), "w", "top_n")
    res = search(model.index(), q, digits=ALBUM_RANK_DIGITS)
    if exclude_seed:
        res = res.where(F.col("query_id") != F.col("cand_id"))
    return res.select("query_id", "rank", F.col("cand_id").alias("id"), "distance")


# ---------------------------------------------------------------- enrichment (Q8)

def release_dates(cat) -> DataFrame:
    """Country date rows, or the unknown-country date when a release has none."""
    r = cat["release"].select("id", "release_group", "name")
    rc = cat["release_country"].select(F.col("release").alias("rc_release"),
                                       F.col("date_year").alias("rc_y"), F.col("date_month").alias("rc_m"),
                                       F.col("date_day").alias("rc_d"))
    ruc = cat["release_unknown_country"].select(F.col("release").alias("ruc_release"),
                                                F.col("date_year").alias("ruc_y"),
                                                F.col("date_month").alias("ruc_m"),
                                                F.col("date_day").alias("ruc_d"))
    j = r.join(rc, r.id == rc.rc_release, "left")
    j = j.join(ruc, (j.id == ruc.ruc_release) & j.rc_release.isNull(), "left")
    return j.select("id", "release_group", "name",
                    F.coalesce("rc_y", "ruc_y").alias("y"), F.coalesce("rc_m", "ruc_m").alias("m"),
                    F.coalesce("rc_d", "ruc_d").alias("d"))


def original_edition(cat, rg_ids: DataFrame | None = None) -> DataFrame:
    """(release_group, release_id) of the original edition of each RG."""
    d = release_dates(cat)
    if rg_ids is not None:
        d = d.join(rg_ids.select(F.col("id").alias("release_group")), "release_group", "left_semi")
    w = Window.partitionBy("release_group").orderBy(
        special_edition("name"), F.col("y").asc_nulls_last(), F.col("m").asc_nulls_last(),
        F.col("d").asc_nulls_last(), F.col("id"))
    return (d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("release_group", F.col("id").alias("release_id")))


def release_stats(cat, rg_ids: DataFrame | None = None) -> DataFrame:
    """Per release: track count and total length (null when every length is null)."""
    r = cat["release"].select(F.col("id").alias("release_id"), "release_group")
    if rg_ids is not None:
        r = r.join(rg_ids.select(F.col("id").alias("release_group")), "release_group", "left_semi")
    m = cat["medium"].select(F.col("id").alias("medium"), F.col("release").alias("release_id"))
    t = cat["track"].select("medium", F.col("id").alias("track_id"), "length")
    return (r.join(m, "release_id").join(t, "medium")
            .groupBy("release_group", "release_id")
            .agg(F.count("track_id").alias("tracks"), F.sum("length").alias("length")))


def rg_length(cat, rg_ids: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """A6 + A8 + J13: original track count, and the first non-null length (by
    release id) among editions with that track count."""
    first = first if first is not None else original_edition(cat, rg_ids)
    rs = release_stats(cat, rg_ids)
    orig = first.join(rs.select(F.col("release_id"), F.col("tracks").alias("original_tracks")),
                      "release_id").select("release_group", "original_tracks")
    cand = rs.select("release_group", F.col("tracks").alias("original_tracks"),
                     F.col("release_id").alias("rid"), F.col("length").alias("len"))
    return (orig.join(cand, ["release_group", "original_tracks"])
            .groupBy("release_group", "original_tracks")
            .agg(F.min_by(F.col("len"), F.when(F.col("len").isNotNull(), F.col("rid"))).alias("length"))
            .select("release_group", F.col("original_tracks").alias("tracks"), "length"))


def rg_artists(cat, rg_ids: DataFrame | None = None) -> DataFrame:
    """A9 + J9: per RG the sorted distinct credited artist names joined by ', ',
    and the (release_group, artist) rows used by the genre lookup."""
    r = cat["release"].select("release_group", "artist_credit")
    if rg_ids is not None:
        r = r.join(rg_ids.select(F.col("id").alias("release_group")), "release_group", "left_semi")
    ac = cat["artist_credit"].select(F.col("id").alias("artist_credit"))
    acn = cat["artist_credit_name"]
    a = cat["artist"].select(F.col("id").alias("artist"), "name")
    return r.join(ac, "artist_credit").join(acn, "artist_credit").join(a, "artist") \
        .select("release_group", "artist", "name").distinct()


def rg_artist_names(ra: DataFrame) -> DataFrame:
    """string_agg(distinct name, ', ' order by name); null when no name."""
    s = F.array_sort(F.collect_set("name"))
    return ra.groupBy("release_group").agg(
        F.when(F.size(s) > 0, F.array_join(s, ", ")).alias("artist"))


def enrich_albums(cat, ranked: DataFrame, key: str = "id") -> DataFrame:
    """Q8 enrichment: id, gid, title, artist, genres, tracks, length; keeps ``rank``.

    RGs without a release or without a credited artist disappear (inner joins)."""
    ids = ranked.select(F.col(key).alias("id")).distinct()
    first = original_edition(cat, ids)
    lens = rg_length(cat, ids, first)
    ra = rg_artists(cat, ids)
    names = rg_artist_names(ra)
    tag = cat["tag"].select(F.col("id").alias("tag"), F.col("name").alias("gname"))
    genre = cat["genre"].select(F.col("name").alias("gname"))
    gen = (ra.select("release_group", "artist").distinct()
           .join(cat["artist_tag"], "artist").join(tag, "tag").join(genre, "gname")
           .groupBy("release_group").agg(F.array_sort(F.collect_set("gname")).alias("genres")))
    rg = cat["release_group"].select(F.col("id").alias("release_group"), "gid", F.col("name").alias("title"))
    out = (first.join(rg, "release_group")
           .join(lens, "release_group", "left")
           .join(gen, "release_group", "left")
           .join(names, "release_group")
           .select(F.col("release_group").alias(key), "gid", "title", "artist",
                   F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
                   "tracks", "length"))
    return ranked.join(out, key)


# ---------------------------------------------------------------- batch requests

def seed_profiles(data: DataFrame, requests: DataFrame) -> DataFrame:
    """A15 per request: (request_id as id, type, status, language, script, year, label arrays)."""
    s = (requests.select("request_id", F.explode(F.array_distinct("seeds")).alias("id"))
         .join(data, "id"))
    aggs = [F.mode(c, deterministic=True).alias(c) for c in CATEGORICAL]
    aggs.append(F.bround(F.avg("year"), 0).cast("int").alias("year"))
    own = s.groupBy("request_id").agg(*aggs)
    # a request's labels, each once, before they are collected
    def named(c: str):
        return F.transform(c, lambda x: F.struct(F.lit(c).alias("list"), x.alias("label")))

    labels = s.select("request_id", F.explode(F.concat(*[named(c) for c in LISTS])).alias("e")) \
        .select("request_id", "e.*").distinct()
    labels = labels.groupBy("request_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("list") == c, F.col("label")))).alias(c) for c in LISTS])
    none = F.array().cast("array<int>")
    return own.join(labels, "request_id", "left").select(
        F.col("request_id").alias("id"), *CATEGORICAL, "year", *[F.coalesce(c, none).alias(c) for c in LISTS])


def recommend_albums_batch(model: AlbumModel, requests: DataFrame, staging: str = "checkpoint") -> DataFrame:
    """K5 for a table of requests (request_id, seeds, blacklist, top_n and, where there is
    such a column, genre_ids) -> (request_id, rank, id, distance).

    Exact: exclusions and genre filters come before the top-k.  Invalid requests and those with
    unknown seeds have no neighbours (see ``with_outcome``).  The result is staged: enrichment
    reads it several times."""
    requests = valid_requests(requests)
    ok = requests.join(missing_seeds(requests, model.data, key="id"), "request_id", "left_anti")
    prof = impute(seed_profiles(model.data, ok), model.stats)
    q = (album_vectors(prof).join(ok.select(F.col("request_id").alias("id"), "top_n"), "id")
         .select(F.col("id").alias("query_id"), F.col("token").alias("key"), "w", "top_n"))
    bl = F.coalesce("blacklist", F.array().cast("array<long>")).cast("array<long>")
    ex = ok.select(F.col("request_id").alias("query_id"),
                   F.explode(F.array_distinct(F.concat(F.col("seeds").cast("array<long>"), bl)))
                   .alias("cand_id"))
    wanted = None
    if "genre_ids" in requests.columns:
        wanted = ok.select(F.col("request_id").alias("query_id"), F.explode("genre_ids").alias("g")) \
            .select("query_id", F.concat(F.lit(LIST_PREFIX["genre_ids"] + ":"),
                                         F.col("g").cast("string")).alias("key"))
    index = model.index()
    with Stages() as scratch:
        r = search(index, q, exclusions=ex, filters=wanted, digits=ALBUM_RANK_DIGITS)
        r = stage(r.select(F.col("query_id").alias("request_id"), "rank", F.col("cand_id").alias("id"),
                           "distance"), staging)
        scratch.release(r)
    return r
