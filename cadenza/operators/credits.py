"""Credit bridges (U1-U3, U8) and catalogue filters used by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 64      # a credit with more than one such part of all rows is dealt out
SALTS = 32


def eligible_artists(artist: DataFrame) -> DataFrame:
    """Artists with a name that is not 'various artists' (any case)."""
    return artist.where(F.col("name").isNotNull() & (F.lower("name") != "various artists"))


def scope_entities(df: DataFrame, n: int | None, key: str = "id") -> DataFrame:
    """The first ``n`` rows by key (None -> all).  ``n`` must be >= 1."""
    if n is None:
        return df
    if n < 1:
        raise ValueError("scope size must be >= 1")
    return df.orderBy(key).limit(n)


def restrict(df: DataFrame, ids: DataFrame | None, key: str, ids_key: str = "id") -> DataFrame:
    """Keep rows of ``df`` whose ``key`` is in ``ids`` (left semi join)."""
    if ids is None:
        return df
    return df.join(ids.select(F.col(ids_key).alias(key)), key, "left_semi")


def hot_credits(cat) -> list[int]:
    """Credits with more than one ``HOT_SHARE``-th of the release or recording rows (``2 * HOT_SHARE``
    at most); counted once for a catalogue."""
    if getattr(cat, "_hot_credits", None) is None:
        found = set()
        for table in ("release", "recording"):
            n = cat[table].groupBy("artist_credit").agg(F.count(F.lit(1)).alias("n"))
            over = n.join(F.broadcast(n.agg(F.sum("n").alias("total"))),       # one row
                          F.col("n") * HOT_SHARE > F.col("total"))
            found |= {r[0] for r in over.select("artist_credit").collect() if r[0] is not None}
        cat._hot_credits = sorted(found)
    return cat._hot_credits


def join_credit(cat, acn: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Artists of a credit (``acn``) beside its ``rows``; a hot credit's rows are dealt to ``SALTS``
    parts by ``key``, and its few artists repeated for each."""
    hot = hot_credits(cat)
    if not hot:
        return acn.join(rows, "artist_credit")
    is_hot = F.col("artist_credit").isin(hot)
    rows = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(
        F.lit(0)).cast("int"))
    acn = acn.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(SALTS - 1)).otherwise(
        F.lit(0)))))
    return acn.join(rows, ["artist_credit", "_salt"]).drop("_salt")


def credited_release_groups(cat, scope: DataFrame | None = None) -> DataFrame:
    """(id = artist, release_group_id) over four credit paths, distinct."""
    acn = restrict(cat["artist_credit_name"], scope, "artist")
    rg = cat["release_group"].select(F.col("id").alias("release_group_id"),
                                     F.col("artist_credit"))
    rel = cat["release"].select(F.col("id").alias("release_id"),
                                F.col("release_group").alias("release_group_id"),
                                "artist_credit")
    a = join_credit(cat, acn, rg, "release_group_id").select(F.col("artist").alias("id"), "release_group_id")
    b = join_credit(cat, acn, rel, "release_id").select(F.col("artist").alias("id"), "release_group_id")
    lrg = restrict(cat["l_artist_release_group"], scope, "entity0")
    c = lrg.select(F.col("entity0").alias("id"), F.col("entity1").alias("release_group_id"))
    lr = restrict(cat["l_artist_release"], scope, "entity0")
    d = (lr.join(rel, lr.entity1 == rel.release_id)
         .select(F.col("entity0").alias("id"), "release_group_id"))
    return a.unionByName(b).unionByName(c).unionByName(d).distinct()


def credited_releases(cat, scope: DataFrame | None = None, crg: DataFrame | None = None) -> DataFrame:
    """(id, release_id): credited releases, releases of U1, direct links."""
    acn = restrict(cat["artist_credit_name"], scope, "artist")
    rel = cat["release"].select(F.col("id").alias("release_id"),
                                F.col("release_group").alias("release_group_id"),
                                "artist_credit")
    if crg is None:
        crg = credited_release_groups(cat, scope)
    a = join_credit(cat, acn, rel, "release_id").select(F.col("artist").alias("id"), "release_id")
    b = crg.join(rel.select("release_group_id", "release_id"), "release_group_id") \
        .select("id", "release_id")
    lr = restrict(cat["l_artist_release"], scope, "entity0")
    c = lr.select(F.col("entity0").alias("id"), F.col("entity1").alias("release_id"))
    return a.unionByName(b).unionByName(c).distinct()


def credited_recordings(cat, scope: DataFrame | None = None) -> DataFrame:
    """(id, recording_id): credited recordings and direct links."""
    acn = restrict(cat["artist_credit_name"], scope, "artist")
    rec = cat["recording"].select(F.col("id").alias("recording_id"), "artist_credit")
    a = join_credit(cat, acn, rec, "recording_id").select(F.col("artist").alias("id"), "recording_id")
    lr = restrict(cat["l_artist_recording"], scope, "entity0")
    b = lr.select(F.col("entity0").alias("id"), F.col("entity1").alias("recording_id"))
    return a.unionByName(b).distinct()


def primary_artists(cat) -> DataFrame:
    """U8: artists credited on any release group or release (distinct ids)."""
    acn = cat["artist_credit_name"]
    rg_credits = cat["release_group"].select("artist_credit")
    rel_credits = cat["release"].select("artist_credit")
    credits = rg_credits.unionByName(rel_credits).distinct()
    return acn.join(credits, "artist_credit", "left_semi").select(F.col("artist").alias("id")).distinct()


def recommendable_artists(cat) -> DataFrame:
    """Q6 candidate set: Person/Group artists credited on an RG or release (P6 + U8)."""
    types = cat["artist_type"].where(F.col("name").isin("Person", "Group")).select(
        F.col("id").alias("type"))
    art = cat["artist"].join(types, "type", "left_semi").select("id")
    return art.join(primary_artists(cat), "id", "left_semi")
