"""Scalar column functions (X1-X22).  All are native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
# Edition words that mark a non-original release (X8), checked on lower(name).
SPECIAL_EDITION_WORDS = ["super deluxe", "deluxe", "expanded", "anniversary", "bonus", "collector"]
# Link type of an artist's official site.
OFFICIAL_SITE_LINK_TYPE = 183
# Type rule thresholds (X9): more than 8 tracks or more than 30 minutes -> album (1);
# exactly one track shorter than 7 minutes -> single (2); otherwise EP (3).
ALBUM_MIN_TRACKS_EXCLUSIVE = 8
ALBUM_MIN_MS_EXCLUSIVE = 30 * 60 * 1000
SINGLE_MAX_MS_EXCLUSIVE = 7 * 60 * 1000
TYPE_ALBUM, TYPE_SINGLE, TYPE_EP = 1, 2, 3
# Public page of an artist.
ARTIST_PAGE = "https://listenbrainz.org/artist/"
# Language codes rewritten before the lookup (X17), and codes whose ASCII-only
# text gets the Latin-script variant.
LANG_RENAMES = {"iw": "he", "tl": "fil"}
LATIN_VARIANT_LANGS = ["bg", "el", "hi", "ja", "ru", "zh"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# A word character is a letter, a number or '_': combining marks and connectors are not.
WORD_CHARS = r"\p{L}\p{N}_"
# White space that a Unicode-aware strip removes at either end.
STRIP_CHARS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def strip(s) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_c(s), f"^[{STRIP_CHARS}]+|[{STRIP_CHARS}]+$", "")


def genre_token(s) -> Column:
    """Strip, lower, runs of non-word characters -> '_', strip '_'."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(strip(s)), f"[^{WORD_CHARS}]+", "_"), r"^_+|_+$", "")


def normalize_ws(s) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(_c(s), r"\s+", " "))


def nonempty_tokens(arr) -> Column:
    """Drop empty tokens from an array of tokens."""
    return F.filter(_c(arr), lambda t: t.isNotNull() & (t != ""))


def clip_pos(x) -> Column:
    """Null -> 0, negative -> 0."""
    return F.greatest(F.coalesce(_c(x), F.lit(0)), F.lit(0))


def special_edition(name) -> Column:
    """1 when the lower-cased release name contains an edition word, else 0."""
    low = F.lower(_c(name))
    cond = None
    for w in SPECIAL_EDITION_WORDS:
        c = low.contains(w)
        cond = c if cond is None else (cond | c)
    return F.when(cond, 1).otherwise(0)


def classify_type(tracks, length_ms) -> Column:
    """Release-group type from track count and total length (ms)."""
    t, ms = _c(tracks), _c(length_ms)
    return (F.when(t.isNull() | ms.isNull(), F.lit(None).cast("int"))
            .when((t > ALBUM_MIN_TRACKS_EXCLUSIVE) | (ms > ALBUM_MIN_MS_EXCLUSIVE), TYPE_ALBUM)
            .when((t == 1) & (ms < SINGLE_MAX_MS_EXCLUSIVE), TYPE_SINGLE)
            .otherwise(TYPE_EP))


def capitalize_first(s) -> Column:
    """Upper first character, lower the rest (not per word)."""
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def format_tracks(n) -> Column:
    """X11: '' / '1 track' / 'n tracks'."""
    n = _c(n)
    return (F.when(n.isNull(), F.lit(""))
            .when(n == 1, F.lit("1 track"))
            .otherwise(F.concat(n.cast("string"), F.lit(" tracks"))))


def format_duration_ms(ms) -> Column:
    """X12: '' / 'N min' / 'Xh' / 'Xh Y min' from milliseconds."""
    ms = _c(ms)
    total_min = F.floor(ms / 60000).cast("long")
    h = F.floor(total_min / 60).cast("long")
    m = (total_min % 60).cast("long")
    return (F.when(ms.isNull(), F.lit(""))
            .when(h == 0, F.concat(m.cast("string"), F.lit(" min")))
            .when(m == 0, F.concat(h.cast("string"), F.lit("h")))
            .otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit(" min"))))


def ui_duration(value) -> Column:
    """Value >= 10000 is milliseconds, else seconds (rounded half up);
    'Xh Y min' / 'N min' / 'N sec'; null when negative or not a number."""
    v = _c(value).try_cast("double")
    v = F.when(F.abs(v) < float("inf"), v)  # not a number: null, and no overflow below
    secs = F.when(v >= 10000, F.round(v / 1000)).otherwise(F.round(v)).cast("long")
    h = F.floor(secs / 3600).cast("long")
    m = F.floor((secs % 3600) / 60).cast("long")
    return (F.when(v.isNull() | F.isnan(v) | (v < 0), F.lit(None).cast("string"))
            .when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit(" min")))
            .when(m > 0, F.concat(m.cast("string"), F.lit(" min")))
            .otherwise(F.concat((secs % 60).cast("string"), F.lit(" sec"))))


def display_details(length, tracks) -> Column:
    """X22: 'duration • n tracks' without the missing parts (null when both are)."""
    t = _c(tracks)
    tr = F.when(t.isNull(), F.lit(None)).when(t == 1, F.lit("1 track")) \
        .otherwise(F.concat(t.cast("string"), F.lit(" tracks")))
    out = F.concat_ws(" \u2022 ", ui_duration(length), tr)
    return F.when(out == "", F.lit(None).cast("string")).otherwise(out)


def jaccard(a, b) -> Column:
    """|a ∩ b| / |a ∪ b| on distinct elements; null when both are empty."""
    a, b = _c(a), _c(b)
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u)


def official_site(urls) -> Column:
    """First url whose type is the official-site link type."""
    return F.get(F.filter(_c(urls), lambda u: u["type"] == OFFICIAL_SITE_LINK_TYPE), 0)["url"]


def as_int_list(x) -> Column:
    """Null -> empty int array."""
    return F.coalesce(_c(x), F.array().cast("array<int>"))


def normalize_lang(code, text=None, ascii_only=None) -> Column:
    """Iw->he, tl->fil; ASCII-only text of some languages -> '<code>-Latn'.

    ``ascii_only`` (has an ASCII letter and no non-ASCII character) may be given
    directly when the text is spread over several rows."""
    code = _c(code)
    renamed = code
    for src, dst in LANG_RENAMES.items():
        renamed = F.when(code == src, F.lit(dst)).otherwise(renamed)
    if ascii_only is None:
        text = _c(text)
        ascii_only = text.rlike(r"[A-Za-z]") & ~text.rlike(r"[^\x00-\x7F]")
    return F.when(renamed.isin(LATIN_VARIANT_LANGS) & ascii_only,
                  F.concat(renamed, F.lit("-Latn"))).otherwise(renamed)


def display_name(name, disambiguation) -> Column:
    """X20: 'name (disambiguation)' or 'name'; missing name -> 'Unknown artist'."""
    n, d = F.coalesce(_c(name), F.lit("Unknown artist")), _c(disambiguation)
    return F.when(d.isNotNull() & (d != ""),
                  F.concat(n, F.lit(" ("), d, F.lit(")"))).otherwise(n)


def display_title(title, artist) -> Column:
    """X20: 'title - artist', or the title alone; missing title -> 'Unknown album'."""
    t, a = F.coalesce(_c(title), F.lit("Unknown album")), _c(artist)
    return F.when(a.isNotNull() & (a != ""), F.concat(t, F.lit(" - "), a)).otherwise(t)


def clamp_int(x, lo: int, hi: int) -> Column:
    """Truncate toward zero and clamp to [lo, hi]."""
    v = _c(x).cast("double")
    # clamped before the cast: NaN and infinities give the minimum, large values the maximum
    v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(float(lo))).otherwise(v)
    v = F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("int")


def ordered_min_listen(min_listen, max_results) -> Column:
    """``min_listen`` is at most ``max_results``."""
    return F.least(_c(min_listen), _c(max_results))


def artist_link(gid) -> Column:
    """Public page of an artist; null without a gid."""
    gid = _c(gid)
    return F.when(gid.isNotNull() & (gid != ""), F.concat(F.lit(ARTIST_PAGE), gid))


def genre_list(genres, most: int | None = None) -> Column:
    """Genres joined by ', ' (null when there are none); ``most`` is a caller's cut."""
    g = F.filter(_c(genres), lambda x: x.isNotNull() & (x != ""))
    if most is not None:
        g = F.slice(g, 1, most)
    return F.when(F.size(g) > 0, F.array_join(g, ", "))


def word_tokens(s) -> Column:
    """Word tokens of a raw string (``\\b\\w+\\b`` with Unicode classes), case kept."""
    return F.regexp_extract_all(_c(s), F.lit(f"[{WORD_CHARS}]+"), 0)
