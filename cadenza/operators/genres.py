"""Tag -> genre classification and genre derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numbering import dense_numbers
from cadenza.functions.scalars import genre_token, strip
from cadenza.session import outlast, stage
from cadenza.operators.credits import (credited_recordings, credited_release_groups,
                                       credited_releases, eligible_artists)


def check_min_count(n: int) -> int:
    """Minimum tag count, validated >= 1."""
    n = int(n)
    if n < 1:
        raise ValueError("min_tag_count must be >= 1")
    return n


def min_count(tags: DataFrame, n: int) -> DataFrame:
    """Votes at least ``n``."""
    return tags.where(F.col("count") >= check_min_count(n))


def tag_genre_ci(cat) -> DataFrame:
    """(tag, genre) pairs matched on lower(name), once for a catalogue.  Small: bounded by the genre list."""
    if getattr(cat, "_tag_genres", None) is None:
        tag = cat["tag"].select(F.col("id").alias("tag"), F.lower("name").alias("k"))
        genre = cat["genre"].select(F.lower("name").alias("k"), F.col("name").alias("genre"))
        # written outside any scope: it lasts as long as the catalogue, and its size is known to later joins
        cat._tag_genres = outlast(tag.join(genre, "k").select("tag", "genre"), name="taggenres")
    return cat._tag_genres


def classify_tags(links: DataFrame, cat) -> DataFrame:
    """Case-sensitive tag -> genre *left* join: (…, tag_id, genre_id or null)."""
    tag = cat["tag"].select(F.col("id").alias("tag_id"), F.col("name").alias("tname"))
    genre = cat["genre"].select(F.col("id").alias("genre_id"), F.col("name").alias("tname"))
    tg = tag.join(genre, "tname", "left").select("tag_id", "genre_id")
    return links.join(tg, "tag_id")


def _tagged_genres(entities: DataFrame, ent_key: str, tags: DataFrame, tag_key: str,
                   tg: DataFrame, n: int) -> DataFrame:
    # tags that are no genre go before the tagged entities are shuffled
    t = min_count(tags, n).select(F.col(tag_key).alias(ent_key), "tag").join(tg, "tag").select(ent_key, "genre")
    return entities.join(t, ent_key).select("id", "genre")


def primary_artist_genres(cat, n: int = 1, crg: DataFrame | None = None,
                          crel: DataFrame | None = None, staging: str = "none") -> DataFrame:
    """U4: (id, genre) from artist tags, direct genre links, RG tags and release tags.

    ``staging`` cuts the lineage of the credit bridge U1, which U2 reads again."""
    tg = tag_genre_ci(cat)
    a = (min_count(cat["artist_tag"], n).join(tg, "tag")
         .select(F.col("artist").alias("id"), "genre"))
    g = cat["genre"].select(F.col("id").alias("entity1"), F.col("name").alias("genre"))
    b = cat["l_artist_genre"].join(g, "entity1").select(F.col("entity0").alias("id"), "genre")
    crg = crg if crg is not None else stage(credited_release_groups(cat), staging)
    crel = crel if crel is not None else credited_releases(cat, crg=crg)
    c = _tagged_genres(crg, "release_group_id", cat["release_group_tag"], "release_group", tg, n)
    d = _tagged_genres(crel, "release_id", cat["release_tag"], "release", tg, n)
    return a.unionByName(b).unionByName(c).unionByName(d).distinct()


def without_primary(cat, primary: DataFrame) -> DataFrame:
    """Eligible artists with no primary genre (anti join)."""
    return eligible_artists(cat["artist"]).select("id").join(primary.select("id"), "id", "left_anti")


def training_pairs(cat, n: int = 1, primary: DataFrame | None = None,
                   staging: str = "none") -> DataFrame:
    """U5's pairs, those of the recordings as often as they occur."""
    n = check_min_count(n)
    primary = primary if primary is not None else stage(primary_artist_genres(cat, n, staging=staging),
                                                          staging)
    scope = without_primary(cat, primary)        # anti join *before* the recording expansion
    crec = credited_recordings(cat, scope)
    fb = _tagged_genres(crec, "recording_id", cat["recording_tag"], "recording",
                        tag_genre_ci(cat), n)
    return primary.unionByName(fb)


def training_genres(cat, n: int = 1, primary: DataFrame | None = None,
                    staging: str = "none") -> DataFrame:
    """Primary genres, plus recording genres only for artists with none.

    The primary genres are read twice (anti join and union); ``staging`` computes
    them once (the reference's temp tables)."""
    return training_pairs(cat, n, primary, staging).distinct()


def extended_genres(cat, n: int = 1, scope: DataFrame | None = None) -> DataFrame:
    """RG + release genres and recording genres for every artist (bag union, distinct)."""
    n = check_min_count(n)
    tg = tag_genre_ci(cat)
    crg = credited_release_groups(cat, scope)
    crel = credited_releases(cat, scope, crg=crg)
    crec = credited_recordings(cat, scope)
    parts = [
        _tagged_genres(crg, "release_group_id", cat["release_group_tag"], "release_group", tg, n),
        _tagged_genres(crel, "release_id", cat["release_tag"], "release", tg, n),
        _tagged_genres(crec, "recording_id", cat["recording_tag"], "recording", tg, n),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def genre_places(names: DataFrame, value: str = "genre") -> DataFrame:
    """X2 + X1 of a genre list: (name, place, first, token), a row per name that has a token.

    ``place`` numbers the names in order of their spelling (X2), ``first`` is the first place of those
    that differ in case alone.
    """
    rows = names.select(value).distinct().withColumn("_spell", strip(value)) \
        .withColumn("token", genre_token("_spell")).where((F.col("_spell") != "") & (F.col("token") != ""))
    rows = dense_numbers(rows.withColumn("_k", F.lower("_spell")), ["_spell", value], "place")
    first = rows.groupBy("_k").agg(F.min("place").alias("first"))
    return rows.join(first, "_k").select(value, "place", "first", "token")


def listed_places(cat) -> DataFrame:
    """``genre_places`` of the catalogue's genres, once for a catalogue."""
    if getattr(cat, "_genre_places", None) is None:
        cat._genre_places = outlast(genre_places(cat["genre"].select(F.col("name").alias("genre"))), name="places")
    return cat._genre_places


def genre_tokens(pairs: DataFrame, key: str = "id", value: str = "genre",
                 out: str = "tokens", places: DataFrame | None = None) -> DataFrame:
    """X2 + X1 + X3 per entity: case-insensitive first spelling (sorted order), then tokens.

    Returns (key, tokens array<string>) ordered by the kept spelling; tokens that
    are empty are dropped, duplicate tokens kept (they count twice in tf).
    ``places`` is ``genre_places`` of a list that holds every value; without it, of the values.
    A genre is spelt and cut once for the list, and a pair is shuffled once, as numbers.
    """
    places = places if places is not None else genre_places(pairs, value)
    kept = (pairs.join(places.select(value, "place", "first"), value).select(key, "place", "first")
            .repartition(key).groupBy(key, "first").agg(F.min("place").alias("place")))
    return (kept.join(places.where(F.col("place") == F.col("first")).select("first", "token"), "first")
            .groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("_s"))
            .select(key, F.transform("_s", lambda s: s["token"]).alias(out)))


def rg_tag_links(cat) -> DataFrame:
    """Release tags lifted to their RG UNION ALL RG tags: (release_group, tag_id)."""
    rel = cat["release"].select(F.col("id").alias("release"), "release_group")
    a = rel.join(cat["release_tag"], "release").select("release_group", F.col("tag").alias("tag_id"))
    b = cat["release_group_tag"].select("release_group", F.col("tag").alias("tag_id"))
    return a.unionByName(b)


def rg_tag_buckets(cat) -> tuple[DataFrame, DataFrame]:
    """A1 + A2 + A3: (release_group, tag_ids) for non-genre tags linked > 1 time and
    (release_group, genre_ids) for genres linked > 0 times, sorted distinct arrays."""
    cl = classify_tags(rg_tag_links(cat), cat)
    tags = (cl.where(F.col("genre_id").isNull())
            .groupBy("release_group", "tag_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
            .groupBy("release_group")
            .agg(F.array_sort(F.collect_set(F.col("tag_id").cast("int"))).alias("tag_ids")))
    genres = (cl.where(F.col("genre_id").isNotNull())
              .groupBy("release_group", "genre_id").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 0)
              .groupBy("release_group")
              .agg(F.array_sort(F.collect_set(F.col("genre_id").cast("int"))).alias("genre_ids")))
    return tags, genres


def release_modes(cat) -> DataFrame:
    """A4: most frequent status / language / script per RG (nulls ignored, ties -> lowest)."""
    return (cat["release"].groupBy("release_group")
            .agg(F.mode("status", deterministic=True).alias("status"),
                 F.mode("language", deterministic=True).alias("language"),
                 F.mode("script", deterministic=True).alias("script")))


def secondary_types(cat) -> DataFrame:
    """A5: sorted distinct secondary types per RG."""
    return (cat["release_group_secondary_type_join"].groupBy("release_group")
            .agg(F.array_sort(F.collect_set(F.col("secondary_type").cast("int")))
                 .alias("secondary_type_ids")))
