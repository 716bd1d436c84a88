"""Feature cache (S4), model artefacts (S5, S6) and the metrics table."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.albums import AlbumModel
from cadenza.operators.recommend import ArtistModel


def _key_path(path: str, key: dict) -> str:
    """A cache path that carries *every* build parameter (no stale hits)."""
    parts = [f"{k}={key[k]}" for k in sorted(key)]
    return os.path.join(path, *parts) if parts else path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS")))


def cached_features(spark: SparkSession, path: str, key: dict, build, refresh: bool = False) -> DataFrame:
    """Read the features for ``key`` if written before, else build, write, read back."""
    p = _key_path(path, key)
    if refresh or not _exists(spark, p):
        build().write.mode("overwrite").parquet(p)
    return spark.read.parquet(p)


# a model's tables by the kind of model; meta.json beside them has the imputation row
ARTEFACTS = {
    "artist_knn": ("features", "vocab", "vectors", "terms", "postings", "cards"),
    "album_knn": ("data", "vectors", "terms"),
}
# columns whose values get a folder each; such a table is read with its schema, as it may have no folder
FOLDERS = {"postings": ("bucket",)}
SCHEMAS = {"postings": "artist_id long, token string, u double, recommendable boolean, bucket int"}


# ---------------------------------------------------------------- versions

def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Committed versions of a store, oldest first."""
    fs, where = _fs(spark, path)
    folder = where(f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the last committed version; None if there is none."""
    found = _commits(spark, path)
    return f"{path}/versions/{found[-1][1]}" if found else None


def write_version(spark: SparkSession, path: str, write, name: str | None = None, keep: int = 2,
                  after: str | None = None) -> str:
    """Write a version of the store ``path``: ``write(folder)`` fills a new folder, then one empty
    commit file makes it the current one.

    Files of a version never change, and the commit file is the last that is written, so a reader
    sees one whole version or the one before, and a failure leaves the store as it was.  ``after``
    (a folder of ``current_version``) refuses the commit where another version came between.
    All but the last ``keep`` versions are deleted.
    """
    name = name or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    folder = f"{path}/versions/{name}"
    write(folder)
    found = _commits(spark, path)
    last = f"{path}/versions/{found[-1][1]}" if found else None
    if after is not None and last != after:
        raise RuntimeError(f"{path}: {last} was written after {after}")
    fs, where = _fs(spark, path)
    number = found[-1][0] + 1 if found else 0
    fs.create(where(f"{path}/commits/{number:012d}-{name}"), False).close()    # fails if it exists
    for old, gone in found[:max(0, len(found) + 1 - keep)]:
        fs.delete(where(f"{path}/commits/{old:012d}-{gone}"), False)
        fs.delete(where(f"{path}/versions/{gone}"), True)
    return folder


# ---------------------------------------------------------------- models

def save_model(model: ArtistModel | AlbumModel, directory: str, name: str | None = None,
               meta: dict | None = None) -> str:
    """A version of the model, stamped with its time; returns the store's path, which
    ``load_model`` reads the last version of."""
    kind = "artist_knn" if isinstance(model, ArtistModel) else "album_knn"
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    info = {"model_kind": kind, "created_at_utc": stamp, **(meta or {})}
    if kind == "artist_knn":
        info = {"genre_feature_format": "genre_token_unigram", **info}
    else:
        info["imputer"] = model.stats.asDict()
    spark = model.vectors.sparkSession
    name = name or kind
    path = os.path.join(directory, name)

    def write(folder: str) -> None:
        for t in ARTEFACTS[kind]:
            getattr(model, t).write.partitionBy(*FOLDERS.get(t, ())).parquet(os.path.join(folder, t))
        spark.createDataFrame([(json.dumps(info),)], "meta string").coalesce(1) \
            .write.text(os.path.join(folder, "meta"))

    write_version(spark, path, write, f"{name}_{stamp}")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[ArtistModel | AlbumModel, dict]:
    """Read the last version of a model written by ``save_model`` (or one version's folder)."""
    path = current_version(spark, path) or path
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    parts = {}
    for t in ARTEFACTS[meta["model_kind"]]:
        reader = spark.read.schema(SCHEMAS[t]) if t in SCHEMAS else spark.read
        parts[t] = reader.parquet(os.path.join(path, t))
    if meta["model_kind"] == "artist_knn":
        return ArtistModel(**parts), meta
    return AlbumModel(stats=Row(**meta["imputer"]), **parts), meta


# ---------------------------------------------------------------- metrics

def upsert_metrics(existing: DataFrame | None, row: DataFrame, key: str = "run_id") -> DataFrame:
    """Replace rows with the same ``run_id``, append the rest (schema by name)."""
    if existing is None:
        return row
    return existing.join(row.select(key), key, "left_anti").unionByName(row, allowMissingColumns=True)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The metrics table's last version; None if there is none."""
    folder = current_version(spark, path)
    return spark.read.parquet(os.path.join(folder, "runs")) if folder else None


def write_metrics(table: DataFrame, path: str, latest_run: str | None = None,
                  after: str | None = None) -> str:
    """S7 sinks as one version: the table (``runs``), as CSV with a header (``runs_csv``), and the
    row of ``latest_run`` as JSON (``latest``)."""
    def write(folder: str) -> None:
        runs = os.path.join(folder, "runs")
        table.coalesce(1).write.parquet(runs)
        back = table.sparkSession.read.parquet(runs)
        back.coalesce(1).write.option("header", "true").csv(os.path.join(folder, "runs_csv"))
        if latest_run is not None:
            back.where(F.col("run_id") == latest_run).coalesce(1).write.json(
                os.path.join(folder, "latest"))

    return write_version(table.sparkSession, path, write, after=after)


def update_metrics(spark: SparkSession, path: str, row: DataFrame, latest_run: str | None = None) -> str:
    """S7's cycle on one path: read the table, replace the row's run, write the next version."""
    return write_metrics(upsert_metrics(read_metrics(spark, path), row), path, latest_run,
                         after=current_version(spark, path))
