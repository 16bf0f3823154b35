"""Maintenance jobs over catalog tables; each takes ``as_of`` instead of the clock."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from tidegauge.functions.times import between, cutoff_month
from tidegauge.operators import retention, rollups, sessions
from tidegauge.sources import tables

log = logging.getLogger(__name__)


def run_retention(spark: SparkSession, database: str, as_of: str) -> dict[str, list[str]]:
    """Drop month partitions older than each table's cutoff. A failing table does not stop the rest."""
    dropped: dict[str, list[str]] = {}
    for table in S.TABLES:
        try:
            keep = retention.keep_months(table)
            cutoff = spark.range(1).select(cutoff_month(F.lit(as_of).cast("timestamp"), keep)).first()[0]
            old = [m for m in tables.partition_months(spark, database, table) if m < cutoff]
            tables.drop_partitions(spark, database, table, old)
            dropped[table] = old
        except Exception:  # noqa: BLE001 - reported, the other tables still run
            log.exception("retention failed for %s", table)
    return dropped


def delete_project(spark: SparkSession, database: str, project_id: str) -> list[str]:
    """Remove all events of a project."""
    return tables.delete_where(spark, database, "events", F.col("project_id") == project_id)


def expire_by_tier(spark: SparkSession, database: str, policies: DataFrame, as_of: Column) -> DataFrame:
    """Events that survive the row-level policy of their project."""
    return retention.tier_retention(spark.table(f"{database}.events"), policies, as_of).filter(~F.col("expired"))


def remove_expired(spark: SparkSession, database: str, policies: DataFrame, as_of: Column) -> list[str]:
    """Delete the events ``expire_by_tier`` leaves out. Export them first. Returns the months rewritten."""
    return tables.delete_marked(
        spark, database, "events", lambda rows: retention.tier_retention(rows, policies, as_of)
    )


def cold_rows(events: DataFrame, policies: DataFrame, as_of: Column) -> DataFrame:
    """Rows due for cold storage: those row-level retention is about to remove."""
    expired = retention.tier_retention(events, policies, as_of).filter("expired")
    return expired.select(*events.columns)


def export_cold(events: DataFrame, policies: DataFrame, as_of: Column, path: str) -> None:
    """Write cold rows as Parquet by run, project and month.

    ``run`` is the time the export stands for. The same run again replaces itself; another run adds to what is there,
    also where a month expires in parts. Partitions are balanced by size, so a project that holds much of the data is
    written by many tasks.
    """
    rows = tables.arranged(cold_rows(events, policies, as_of), "events")
    rows = rows.withColumn("run", F.date_format(as_of, "yyyyMMdd'T'HHmmss"))
    balanced = rows.hint("rebalance", "project_id", "month")
    _replace(balanced.sortWithinPartitions("project_id", "month", "timestamp"), path, "run", "project_id", "month")


def compress_free_tier(spark: SparkSession, events: DataFrame, policies: DataFrame, as_of: Column, path: str) -> None:
    """Write the daily rollups that stand in for the free tier's old raw rows, whole days only.

    Partitioned by project, day and run: the same run again replaces itself, and events that come after their day
    was compressed add to it under a later run.
    """
    rows = rollups.daily_rollup(retention.compressible(events, policies, as_of, whole_days=True))
    stamped = rows.withColumns({"day": F.to_date("date"), "run": F.date_format(as_of, "yyyyMMdd'T'HHmmss")})
    _replace(stamped, path, "project_id", "day", "run")


def compress_and_remove(spark: SparkSession, database: str, policies: DataFrame, as_of: Column, path: str) -> list[str]:
    """Compress the free tier's old events, then delete them. Repeat a run that failed with its own ``as_of``."""
    compress_free_tier(spark, spark.table(f"{database}.events"), policies, as_of, path)
    return tables.delete_marked(
        spark, database, "events", lambda rows: retention.mark_compressible(rows, policies, as_of, whole_days=True)
    )


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    """Overwrite exactly the partitions that ``rows`` holds."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


def backfill(
    events: DataFrame,
    project_id: str | None,
    start: Column,
    end: Column,
    as_of: Column,
    padding_hours: int | None = None,
) -> dict[str, DataFrame]:
    """Recompute hourly and daily rollups of a range, and every session with an event in it.

    A session is rebuilt from all its events. ``padding_hours`` bounds how far
    around the range they are looked for, so that other months are not read.
    Without ``project_id`` all projects are recomputed.
    """
    scope = events if project_id is None else events.filter(F.col("project_id") == project_id)
    rows = between(scope, start, end)
    if padding_hours is not None:
        pad = F.expr(f"INTERVAL {padding_hours} HOURS")
        scope = between(scope, start - pad, end + pad)
    touched = rows.select("project_id", "session_id").distinct()
    return {
        "sessions": sessions.sessions(scope.join(touched, ["project_id", "session_id"], "left_semi"), as_of),
        "hourly": rollups.hourly_rollup(rows),
        "daily": rollups.daily_rollup(rows),
    }


def backfill_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Counts of recomputed rows per project."""
    sessions_count = parts["sessions"].groupBy("project_id").agg(F.count("*").alias("sessions_recomputed"))
    hourly = parts["hourly"].groupBy("project_id").agg(F.count("*").alias("hourly_rows"))
    daily = parts["daily"].groupBy("project_id").agg(
        F.count("*").alias("daily_rows"), F.sum("count").alias("events_processed")
    )
    return daily.join(hourly, "project_id").join(sessions_count, "project_id")


def write_backfill(parts: dict[str, DataFrame], database: str, root: str) -> None:
    """Store what ``backfill`` computed, for a range of whole days.

    Sessions are appended as new versions (the newest ``updated_at`` wins on
    read). Rollups replace exactly the project and day partitions they hold, so
    running it again gives the same tables and other projects stay untouched.
    """
    tables.append(parts["sessions"], database, "sessions")
    for name, time in (("hourly", "hour"), ("daily", "date")):
        rows = parts[name].withColumn("day", F.to_date(time))
        _replace(rows, f"{root}/{name}_rollup", "project_id", "day")
