"""Session helpers: local session for tests/bench, checkpoint directory, staging."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cadenza") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CADENZA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a scratch folder only for a local master.

    On a cluster an unset folder is an error: every executor and the driver would
    write to disks of their own.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if conf:
        if not current:
            sc.setCheckpointDir(conf)
        return conf
    if current:
        return current
    require_local_master(sc.master)
    path = tempfile.mkdtemp(prefix="cadenza-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def require_local_master(master: str) -> None:
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the cluster shares ({master})")


_STAGE_ROOTS: dict[str, SparkSession] = {}


def stage(df: DataFrame, how: str = "checkpoint", name: str = "stage", by: list[str] | None = None) -> DataFrame:
    """Cut lineage between pipeline stages.

    ``checkpoint`` writes Parquet once below the shared checkpoint folder and reads it
    back (a lost executor costs a re-read; later plans prune columns and know sizes);
    the application's folder goes when the driver ends.  ``persist`` keeps the frame
    cached, ``none`` returns ``df`` unchanged.  ``by`` names columns whose values get a folder each.
    """
    if how == "none":
        return df
    if how == "persist":
        return df.persist()
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession, name: str) -> str:
    root = f"{ensure_checkpoint_dir(spark)}/cadenza-{spark.sparkContext.applicationId}"
    if root not in _STAGE_ROOTS:
        _STAGE_ROOTS[root] = spark
        atexit.register(_drop_stages, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].paths.append((spark, path))
    return path


def outlast(df: DataFrame, name: str = "stage") -> DataFrame:
    """``stage`` for what is kept beyond the scopes that are entered."""
    entered, _SCOPES[:] = list(_SCOPES), []
    try:
        return stage(df, name=name)
    finally:
        _SCOPES[:] = entered


class Stages:
    """Lifetime of staged tables: those written while a scope is entered belong to it.

    ``release(*keep)`` deletes them but for those that the frames in ``keep`` still read; it is
    called when whatever else read them has been written.  What is left when a scope ends belongs
    to the scope around it, or stays until the driver ends.
    """

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Stages:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.remove(self)
        if _SCOPES:
            _SCOPES[-1].paths += self.paths
            self.paths = []

    def release(self, *keep: DataFrame) -> None:
        used = {part for df in keep for f in df.inputFiles() for part in f.split("/")}
        left = []
        for spark, path in self.paths:
            if path.rsplit("/", 1)[1] in used:
                left.append((spark, path))
            else:
                _delete(spark.sparkContext, path)
        self.paths = left


_SCOPES: list[Stages] = []


def _delete(sc, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _drop_stages(root: str) -> None:
    """Delete an application's staged tables while its JVM is still there."""
    sc = _STAGE_ROOTS.pop(root).sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    _delete(sc, root)
