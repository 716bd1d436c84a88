"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the whole catalogue derived from the supplied tables.
Request parameters (seed sets, search text, ranges) are arguments of the
operators; batch queries derive their request tables from the data itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.session import staging_path
from cadenza.sources.catalog import fixture_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# One request used by the single-request queries (FIXTURES.md suggestion).
SEEDS = [1, 2, 4]
BLACKLIST = [33]
TOP_N = 5

_CATALOGS: dict = {}


def catalog(spark: SparkSession, sf_dir: str):
    """Catalogue for a data directory: the FIXTURES.md views over the supplied
    tables, unless a materialised catalogue was registered with ``use_catalog``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        # each view is written once to the shared staging folder when first used
        _CATALOGS[key] = fixture_catalog(spark, sf_dir, staging_path(spark, "catalog"))
    return _CATALOGS[key]


def use_catalog(spark: SparkSession, sf_dir: str, cat) -> None:
    """Serve ``cat`` (for example ``load_catalog`` of written tables) for ``sf_dir``."""
    _CATALOGS[(spark.sparkContext.applicationId, sf_dir)] = cat


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco
