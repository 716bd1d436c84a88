"""Structured Streaming form of Q12: running listen counts per user and item.

Listens arrive as files (or any streaming source) with an event-time ``ts``; counts are kept per
(user, item, calendar window) with a watermark, so late listens within the allowed delay still count
and old state is dropped.  Every micro-batch upserts the counts that it changed: it writes them to the
folder of its batch id, so a batch that runs again after a failure replaces itself, and a window's count
is the one of its last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KINDS = ("click", "view", "purchase")


def windowed_listen_counts(listens: DataFrame, window: str = "7 days", delay: str = "1 day",
                           item: str = "artist") -> DataFrame:
    """(window, user_id, item, listen_count) per tumbling event-time window."""
    return (listens.withWatermark("ts", delay)
            .groupBy(F.window("ts", window, startTime="4 days"), "user_id", item)   # weeks start Monday
            .agg(F.count(F.lit(1)).alias("listen_count")))


def listens_of(events: DataFrame) -> DataFrame:
    return (events.where(F.col("event_type").isin(*KINDS))
            .select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
                    F.regexp_extract("props", r"([0-9]+)", 1).cast("long").alias("artist")))


def start_listen_counts(spark: SparkSession, source_dir: str, schema, checkpoint: str, path: str,
                        window: str = "7 days", delay: str = "1 day") -> StreamingQuery:
    """Run the windowed counts over a directory of Parquet files into the counts table ``path``.

    ``checkpoint`` and ``path`` are folders that the cluster shares; started again with the same two,
    the query goes on where it was."""
    counts = windowed_listen_counts(listens_of(spark.readStream.schema(schema).parquet(source_dir)),
                                    window, delay)

    def upsert(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (counts.writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).start())


def _folders(spark: SparkSession, path: str) -> tuple[dict[int, str], dict[int, str], list[int]]:
    """Folders of the counts table: whole batches and whole compactions by number, and the numbers of
    batches that are not whole."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(sc._jsc.hadoopConfiguration())
    batches, merged, torn = {}, {}, []
    for f in fs.listStatus(where(path)) if fs.exists(where(path)) else []:
        kind, _, number = f.getPath().getName().partition("=")
        if kind in ("batch", "upto"):
            if fs.exists(where(f.getPath(), "_SUCCESS")):
                (batches if kind == "batch" else merged)[int(number)] = f.getPath().toString()
            elif kind == "batch":
                torn.append(int(number))
    return batches, merged, torn


def _last_counts(spark: SparkSession, batches: dict[int, str], merged: tuple[int, str] | None,
                 item: str) -> DataFrame | None:
    frames = [spark.read.parquet(p).withColumn("batch", F.lit(n).cast("long"))
              for n, p in ([merged] if merged else [])]
    if batches:
        rows = spark.read.parquet(*batches.values())
        number = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/[^/]*$", 1)
        frames.append(rows.withColumn("batch", number.cast("long")))
    if not frames:
        return None
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return rows.groupBy("window", "user_id", item).agg(
        F.max_by("listen_count", "batch").alias("listen_count"))


def read_listen_counts(spark: SparkSession, path: str, item: str = "artist") -> DataFrame | None:
    """(window, user_id, item, listen_count): the counts of the batches written whole so far, those up to
    the last compaction from its folder."""
    batches, merged, _ = _folders(spark, path)
    last = max(merged.items(), default=None)
    return _last_counts(spark, {n: p for n, p in batches.items() if last is None or n > last[0]}, last, item)


def compact_listen_counts(spark: SparkSession, path: str, item: str = "artist") -> int | None:
    """Merge all batches but the last into one folder ``upto=<batch>``; returns that batch's number, None
    if there is nothing to merge.

    The last batch may run again after a failure, so it stays by itself, as do all from one on that is not
    whole.  The folder counts once it is whole, so a failure leaves the table as it was, and what it
    replaces is deleted by the compaction after it: a reader that listed the folders before can end.  It
    may run beside the stream; two compactions at a time may not.
    """
    batches, merged, torn = _folders(spark, path)
    last = max(merged.items(), default=None)
    stop = min([*torn, max(batches, default=0)])
    new = {n: p for n, p in batches.items() if n < stop and (last is None or n > last[0])}
    if not new:
        return None
    upto = max(new)
    _last_counts(spark, new, last, item).write.mode("overwrite").parquet(f"{path}/upto={upto}")
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(sc._jsc.hadoopConfiguration())
    gone = [] if last is None else [p for n, p in batches.items() if n <= last[0]] + [
        p for n, p in merged.items() if n < last[0]]
    for p in gone:
        fs.delete(where(p), True)
    return upto
