"""Rows to broker records: key, value, topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S

RECORD_COLUMNS = [part.split()[0] for part in S.BROKER_RECORD.split(",")]


def broker_records(events: DataFrame) -> DataFrame:
    """``key`` is project:session, ``value`` the row as JSON with epoch-ms time.

    Null fields are written as JSON nulls and the type goes under ``type``.
    """
    row = events.withColumns({"type": F.col("event_type"), "timestamp": F.unix_millis("timestamp")})
    return row.select(
        F.concat_ws(":", "project_id", "session_id").alias("key"),
        F.to_json(F.struct(*RECORD_COLUMNS), {"ignoreNullFields": "false"}).alias("value"),
    )


def route_by_type(events: DataFrame) -> DataFrame:
    """Add ``topic``; only the five legacy types have a topic of their own."""
    kind = F.col("event_type")
    return events.withColumn("topic", F.when(kind.isin(S.LEGACY_TYPES), F.concat(F.lit("events_"), kind)))


def partition_key(strategy: str, session: Column, tenant: Column) -> Column:
    """Record key: by "session" (the default ordering), by "tenant", or "round_robin" (null)."""
    if strategy == "session":
        return session
    if strategy == "tenant":
        return tenant
    if strategy == "round_robin":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown strategy {strategy}")


def ordered_by_key(events: DataFrame, strategy: str, partitions: int) -> DataFrame:
    """Co-locate the rows of a key and keep their time order inside a partition."""
    keyed = events.withColumn("key", partition_key(strategy, F.col("session_id"), F.col("project_id")))
    spread = keyed.repartition(partitions) if strategy == "round_robin" else keyed.repartition(partitions, "key")
    return spread.sortWithinPartitions("key", "timestamp", "event_id")
