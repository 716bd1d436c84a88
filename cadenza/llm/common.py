"""Helpers shared by the corpus operators: table access, staging, worker-side cache."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"      # separators; a word is a run of anything else
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c):
    """A-Z in lower case, all else as it is.

    ``lower`` does that for texts without other capitals and is much faster than ``translate``."""
    other = c.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(other, F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back (``session.stage``)."""
    return stage(df, name=name)


def worker_cache() -> dict:
    """One dictionary per Python worker process.

    Task functions are shipped by value (``ship``), so module globals would be rebuilt for
    each task; loaded vocabularies and tables live here instead.
    """
    name = "_cadenza_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__.setdefault("cache", {})


def ship() -> None:
    """Pickle this subpackage's functions by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules["cadenza.llm"])
