"""Windowed streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.schemas import SESSION_TIMEOUT_MINUTES
from tidegauge.streaming.sinks import write_epoch

DELAY = "24 hours"  # how late an event may be, as at ingestion


def hourly_counts(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events per hour, project and type; state is dropped ``delay`` after the hour."""
    hour = F.window("timestamp", "1 hour")
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(hour, "project_id", "event_type")
        .agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("hour"), "project_id", "event_type", "count")
    )


def closed_sessions(events: DataFrame, keys: list[str], minutes: int = SESSION_TIMEOUT_MINUTES, delay: str = DELAY) -> DataFrame:
    """Visits by inactivity, emitted once the watermark has passed their end."""
    window = F.session_window("timestamp", f"{minutes} minutes")
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(*keys, window)
        .agg(
            F.min("timestamp").alias("started_at"),
            F.max("timestamp").alias("last_active_at"),
            F.count("*").alias("event_count"),
        )
        .select(*keys, "started_at", "last_active_at", "event_count")
    )


def write_updates(rows: DataFrame, path: str, checkpoint: str, mode: str, once: bool = False) -> StreamingQuery:
    """Store every micro-batch of results; in update mode read back the newest per key."""
    writer = (
        rows.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, epoch: write_epoch(batch, path, epoch))
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if once else {"processingTime": "1 minute"}
    return writer.trigger(**trigger).start()
