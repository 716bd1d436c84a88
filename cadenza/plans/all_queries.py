"""Import every query module so that its queries register themselves."""

from cadenza.plans import album_queries, artist_queries, misc_queries  # noqa: F401
