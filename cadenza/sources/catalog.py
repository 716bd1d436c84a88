"""Catalogue sources (S1): base-table scan, fixture catalogue, parquet catalogue."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from cadenza.functions.numbering import dense_numbers
from cadenza.session import stage
from cadenza.sources.fixtures import BASE_TABLES, CATALOG_TABLES, LINES, LINKED_GROUPS, NUMBERED, PLANNED, VIEWS


class Catalog(Mapping):
    """Lazy name -> DataFrame mapping.  Nothing is read until a table is used."""

    def __init__(self, spark: SparkSession, builders: dict):
        self.spark = spark
        self._builders = builders
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._builders:
                raise KeyError(name)
            self._frames[name] = self._builders[name](self)
        return self._frames[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet scan of one table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(path, f"{name}.parquet"))


def _view(spark: SparkSession, c: Catalog, text: str, **frames: DataFrame) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", text)) - set(frames)
    return spark.sql(text, **{n: c[n] for n in names}, **frames)


def _numbered(spark: SparkSession, c: Catalog, names: str, text: str) -> DataFrame:
    rows = dense_numbers(_view(spark, c, names), ["name"], "id", start=1)
    return _view(spark, c, text, names=rows)


def _linked_groups(spark: SparkSession, c: Catalog) -> DataFrame:
    """``l_artist_release_group``: a line of ``lt`` has its supplier beside it; only lines without a tag,
    mostly none, look for another of their key."""
    untagged = c["lines"].where("tag is null").select("l_orderkey", "l_linenumber", "l_suppkey")
    # written, so that its size is known and the lines stay where they are if it is small
    return _view(spark, c, LINKED_GROUPS, untagged=stage(untagged, name="untagged"))


def fixture_catalog(spark: SparkSession, sf_dir: str, materialize_to: str | None = None) -> Catalog:
    """Catalogue whose tables are the FIXTURES.md views over the supplied data.

    With ``materialize_to`` every view is written once as a parquet table under that
    (shared) folder the first time it is used and read back from there, so later
    queries scan small parquet tables (with pushdown) instead of re-deriving the
    view chain; views are built from their inputs' written tables.
    """
    builders = {}
    for t in BASE_TABLES:
        builders[t] = (lambda c, t=t: read_table(spark, sf_dir, t))
    for v, text in {"lines": LINES, **VIEWS, **PLANNED}.items():
        def build(c, v=v, text=text):
            if v == "lt":
                return c["lines"].where("tag is not null").drop("l_suppkey")
            if v in NUMBERED:
                df = _numbered(spark, c, *NUMBERED[v])
            elif v == "l_artist_release_group":
                df = _linked_groups(spark, c)
            else:
                df = _view(spark, c, text)
            if materialize_to is None:
                return df
            path = os.path.join(materialize_to, f"{v}.parquet")
            df.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)
        builders[v] = build
    return Catalog(spark, builders)


def load_catalog(spark: SparkSession, path: str, tables=CATALOG_TABLES,
                 base_dir: str | None = None) -> Catalog:
    """Catalogue stored as one parquet dataset per table under ``path``; the
    supplied base tables (documents, events, ...) are read from ``base_dir``."""
    builders = {}
    if base_dir is not None:
        builders.update({t: (lambda c, t=t: read_table(spark, base_dir, t)) for t in BASE_TABLES})
    builders.update({t: (lambda c, t=t: read_table(spark, path, t)) for t in tables})
    return Catalog(spark, builders)


def write_catalog(cat: Catalog, path: str, tables=CATALOG_TABLES) -> None:
    """Materialise catalogue tables as parquet (the inverse of ``load_catalog``)."""
    for t in tables:
        cat[t].write.mode("overwrite").parquet(os.path.join(path, f"{t}.parquet"))
