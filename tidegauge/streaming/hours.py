"""Hourly counts as increments: what comes late corrects its hour, and is counted as late.

Every micro-batch stores its own counts per hour, project and type; the table of hours is their sum. No state is kept, so
nothing is dropped behind a watermark. The watermark is the newest time of the micro-batches before, less ``delay``; rows
behind it, which a stateful aggregate would drop, are counted in ``late`` and can be written aside. A replay reads the
same earlier mark and overwrites its own folders.

``compact`` sums finished micro-batches into one folder, ``compact=N``; readers take the newest one and the micro-batches
after N, so a crash before the old folders are removed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.sources import tables
from tidegauge.streaming.sinks import write_epoch
from tidegauge.streaming.windows import DELAY

_KEYS = ["hour", "project_id", "event_type"]
_COUNTS = "hour TIMESTAMP, project_id STRING, event_type STRING, count BIGINT, late BIGINT"
_MARK = "newest TIMESTAMP"


def _mark_before(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """One row: the newest event time of all earlier micro-batches, null at the start."""
    folder = f"{path}/_marks/epoch={epoch - 1}"
    if not tables.exists(spark, f"{folder}/_SUCCESS"):
        return spark.range(1).select(F.lit(None).cast("timestamp").alias("newest"))
    return spark.read.schema(_MARK).parquet(folder)


def store_increment(
    batch: DataFrame, epoch: int, path: str, delay: str = DELAY, late_path: str | None = None
) -> None:
    """Store a micro-batch's counts, its late rows if wanted, and the mark for the next one."""
    spark = batch.sparkSession
    before = _mark_before(spark, path, epoch).first()["newest"]
    limit = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    behind = F.coalesce(F.col("timestamp") < limit, F.lit(False))
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    counts = batch.groupBy(hour, "project_id", "event_type").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(behind).alias("late"), F.max("timestamp").alias("newest")
    )
    counts = counts.persist()
    try:
        if late_path:
            write_epoch(batch.where(behind), late_path, epoch)
        write_epoch(counts.drop("newest"), path, epoch)
        newest = counts.agg(F.greatest(F.max("newest"), F.lit(before).cast("timestamp")).alias("newest"))
        write_epoch(newest, f"{path}/_marks", epoch)
    finally:
        counts.unpersist()


def hourly_increments(
    events: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = DELAY,
    late_path: str | None = None,
    once: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Run ``store_increment`` over a stream of events."""
    columns = events if late_path else events.select("project_id", "event_type", "timestamp")
    writer = columns.writeStream.foreachBatch(lambda batch, epoch: store_increment(batch, epoch, path, delay, late_path))
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _numbered(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    folders = tables.finished_folders(spark, path, prefix)
    return {int(f.rstrip("/").rsplit(prefix, 1)[1]): f for f in folders}


def _current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last number summed up, and the folders that make up the table."""
    sums, epochs = _numbered(spark, path, "compact="), _numbered(spark, path, "epoch=")
    upto = max(sums, default=-1)
    return upto, ([sums[upto]] if sums else []) + [f for n, f in sorted(epochs.items()) if n > upto]


def hourly_totals(spark: SparkSession, path: str) -> DataFrame:
    """``hour, project_id, event_type, count, late`` over all that is stored."""
    folders = _current(spark, path)[1]
    rows = spark.read.schema(_COUNTS).parquet(*folders) if folders else spark.createDataFrame([], _COUNTS)
    return rows.groupBy(*_KEYS).agg(F.sum("count").alias("count"), F.sum("late").alias("late"))


def compact(spark: SparkSession, path: str) -> int:
    """Sum the finished micro-batches up; returns the last one summed, -1 if there is none."""
    epochs = _numbered(spark, path, "epoch=")
    upto, folders = _current(spark, path)
    last = max([upto, *epochs])
    if last > upto:
        hourly_totals(spark, path).write.mode("overwrite").parquet(f"{path}/compact={last}")
    for prefix in ("epoch=", "compact="):
        for number, folder in _numbered(spark, path, prefix).items():
            if number < last or (number == last and prefix == "epoch="):
                tables.remove_folder(spark, folder)
    return last
