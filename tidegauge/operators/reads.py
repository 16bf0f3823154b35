"""Read queries over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.text import format_bytes

LATEST_COLUMNS = ["event_id", "project_id", "session_id", "event_type", "timestamp", "url", "path"]


def count_events(events: DataFrame, project_id: str) -> DataFrame:
    return events.filter(F.col("project_id") == project_id).agg(F.count("*").alias("count"))


def count_by_project(events: DataFrame) -> DataFrame:
    return events.groupBy("project_id").agg(F.count("*").alias("count"))


def count_all_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("count"))


def latest_events(events: DataFrame, limit: int, project_id: str | None = None) -> DataFrame:
    """Newest rows first; ties by event id. Runs as a per-partition top-k and a merge."""
    if project_id is not None:
        events = events.filter(F.col("project_id") == project_id)
    return events.select(*LATEST_COLUMNS).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


def ingest_rate(events: DataFrame, as_of: Column) -> DataFrame:
    """Events per second over the hour before ``as_of``."""
    recent = events.filter((F.col("timestamp") > as_of - F.expr("INTERVAL 1 HOUR")) & (F.col("timestamp") <= as_of))
    return recent.agg(F.count("*").alias("events"), (F.count("*") / 3600).alias("events_per_second"))


def ingest_rate_by_minute(events: DataFrame) -> DataFrame:
    minute = F.date_trunc("minute", "timestamp").alias("minute")
    return events.groupBy(minute).agg(F.count("*").alias("events"), (F.count("*") / 60).alias("events_per_second"))


def disk_usage(disks: DataFrame, threshold: float | None = None) -> DataFrame:
    """Used share of each disk in percent; with ``threshold`` only fuller ones."""
    used = F.round(100 - F.col("free_space") / F.col("total_space") * 100, 2)
    rows = disks.filter(F.col("total_space") > 0)
    if threshold is not None:
        rows = rows.filter(100 - F.col("free_space") / F.col("total_space") * 100 > threshold)
    return rows.select("name", "path", "free_space", "total_space", used.alias("usage_percent"))


def file_sizes(table: DataFrame, name: str) -> DataFrame:
    """One row per data file of a Parquet table: rows and bytes, from the file metadata."""
    return (
        table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy("file", "bytes")
        .agg(F.count("*").alias("rows"))
        .select(F.lit(name).alias("table"), "file", "rows", "bytes")
    )


def storage_by_table(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("table")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("files"))
        .withColumn("size", format_bytes(F.col("bytes")))
        .orderBy(F.desc("bytes"), "table")
    )


def storage_by_partition(files: DataFrame) -> DataFrame:
    """Bytes and rows per table and partition, the partition being the file's ``month=`` folder."""
    partition = F.nullif(F.regexp_extract("file", "/month=([^/]+)/", 1), F.lit(""))
    return (
        files.groupBy("table", F.coalesce(partition, F.lit("all")).alias("partition"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("files"))
        .withColumn("size", format_bytes(F.col("bytes")))
        .orderBy("table", "partition")
    )
