"""Month-partition retention and per-tier row retention. ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S
from tidegauge.functions.text import format_bytes
from tidegauge.functions.times import cutoff_month, month
from tidegauge.operators.rollups import daily_rollup, tier_value


def keep_months(table: str) -> int:
    return S.METRICS_KEEP_MONTHS if table == "internal_metrics" else S.DATA_TABLE_KEEP_MONTHS


def partition_stats(rows: DataFrame, time: str = "timestamp", size: Column | None = None) -> DataFrame:
    """Rows and bytes per month. ``size`` is the byte size of a row (default: its ``data``)."""
    partition = F.col("month") if "month" in rows.columns else month(F.col(time))
    return rows.groupBy(partition.alias("partition")).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("data") if size is None else size).alias("bytes")
    )


def expired_partitions(stats: DataFrame, as_of: Column, keep: int) -> DataFrame:
    """Partitions older than the cutoff month: what retention would drop."""
    return (
        stats.filter(F.col("partition") < cutoff_month(as_of, keep))
        .withColumn("size", format_bytes(F.col("bytes")))
        .orderBy("partition")
    )


def survivors(rows: DataFrame, as_of: Column, keep: int, time: str = "timestamp") -> DataFrame:
    """Rows whose month partition is kept."""
    partition = F.col("month") if "month" in rows.columns else month(F.col(time))
    return rows.filter(partition >= cutoff_month(as_of, keep))


def effective_retention(policies: DataFrame) -> DataFrame:
    """Hours per policy: its override, else the default of its tier."""

    def hours(override: str, setting: str) -> Column:
        return F.coalesce(F.col(override).cast("bigint"), tier_value(F.col("tier"), setting)).alias(setting)

    return policies.select(
        "project_id",
        "tier",
        hours("raw_retention_hours", "raw_hours"),
        hours("aggregate_retention_hours", "aggregate_hours"),
        hours("compression_after_hours", "compress_hours"),
    )


def _aged(events: DataFrame, policies: DataFrame, hours: str, as_of: Column, how: str) -> DataFrame:
    limits = effective_retention(policies).select("project_id", F.col("tier").alias("_tier"), F.col(hours).alias("_hours"))
    age_ms = F.unix_millis(as_of) - F.unix_millis("timestamp")
    return events.join(limits, "project_id", how).withColumn(
        "expired", F.coalesce(age_ms > F.col("_hours") * 3_600_000, F.lit(False))
    )


def tier_retention(events: DataFrame, policies: DataFrame, as_of: Column) -> DataFrame:
    """Add ``expired``: the raw row is older than its project's policy allows.

    A project without a policy keeps its rows.
    """
    return _aged(events, policies, "raw_hours", as_of, "left").drop("_tier", "_hours")


def compressible(
    events: DataFrame, policies: DataFrame, as_of: Column, tier: str = "free", whole_days: bool = False
) -> DataFrame:
    """Rows of a tier's projects that are past their compression delay; with ``whole_days`` of days past it whole."""
    marked = mark_compressible(events, policies, as_of, tier, whole_days)
    return marked.filter("expired").select(*events.columns)


def mark_compressible(
    events: DataFrame, policies: DataFrame, as_of: Column, tier: str = "free", whole_days: bool = False
) -> DataFrame:
    """Add ``expired`` to the rows ``compressible`` would return."""
    rows = events
    if whole_days:
        # The day is past its delay once its last millisecond is.
        last = F.timestamp_millis(F.unix_millis(F.date_trunc("day", "timestamp") + F.expr("INTERVAL 1 DAY")) - 1)
        rows = events.withColumn("_at", F.col("timestamp")).withColumn("timestamp", last)
    aged = _aged(rows, policies, "compress_hours", as_of, "left")
    if whole_days:
        aged = aged.withColumn("timestamp", F.col("_at")).drop("_at")
    due = F.col("expired") & F.coalesce(F.col("_tier") == tier, F.lit(False))
    return aged.withColumn("expired", due).drop("_tier", "_hours")


def compress(events: DataFrame, policies: DataFrame, as_of: Column, tier: str = "free") -> DataFrame:
    """Daily rollup rows that replace the raw rows of ``compressible``."""
    return daily_rollup(compressible(events, policies, as_of, tier))
