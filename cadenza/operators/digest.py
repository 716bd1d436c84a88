"""Recommendation digests (S10) and the seeded shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import format_duration_ms, format_tracks

CATALOGUE_RG_URL = "https://listenbrainz.org/release-group/"


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable shuffle: order by a hash of (seed, key)."""
    return df.orderBy(shuffle_key(F.col(key), seed), key)


def shuffle_key(value, seed: int = 42):
    """The hash that seeded choices order by (the same in any engine that has md5)."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), value.cast("string")).cast("binary"))


def album_digest(enriched: DataFrame, seed: int = 42, request: str = "request_id") -> DataFrame:
    """One markdown text per request from enriched, ranked albums.

    Block per album: '**title** - artist', up to five genres picked by a seeded
    hash (repeatable instead of random), 'tracks - duration', links; empty lines
    are dropped and blocks are separated by a blank line.
    """
    picked = F.slice(F.transform(
        F.array_sort(F.transform("genres", lambda g: F.struct(shuffle_key(g, seed).alias("h"),
                                                             g.alias("g")))),
        lambda s: s["g"]), 1, 5)
    details = F.concat_ws(" - ", F.when(format_tracks("tracks") != "", format_tracks("tracks")),
                          F.when(format_duration_ms("length") != "", format_duration_ms("length")))
    block = F.concat_ws("\n",
                        F.concat(F.lit("**"), F.col("title"), F.lit("** - "), F.coalesce("artist", F.lit(""))),
                        F.when(F.size("genres") > 0, F.array_join(picked, ", ")),
                        F.when(details != "", details),
                        F.concat(F.lit("[ListenBrainz](" + CATALOGUE_RG_URL), F.col("gid"), F.lit(")")))
    if request not in enriched.columns:
        enriched = enriched.withColumn(request, F.lit(0))
    return (enriched.groupBy(request)
            .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_b"))
            .select(request, F.concat(F.lit("# Recommended release groups\n\n"),
                                      F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n")).alias("digest")))
