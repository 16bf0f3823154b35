"""Re-delivered and sampled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per project and event id: the delivery stored first (``created_at``), of equal ones the smallest row.

    Copies are merged on the map side first.
    """
    order = [c for c in ("created_at", "received_at", "timestamp") if c in events.columns]
    whole = F.struct(*order, *[c for c in events.columns if c not in order])
    first = events.groupBy("project_id", "event_id").agg(F.min(whole).alias("_first"))
    return first.select(*[F.col(f"_first.`{c}`") for c in events.columns])


def sample_bucket(session_id: Column) -> Column:
    """0-99 from a hash any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(session_id), 1, 8), 16, 10).cast("bigint") % 100


def sample_high_volume(events: DataFrame, percent: int) -> DataFrame:
    """Keep ``percent`` of the sessions' high-volume events and all other events.

    Deterministic: a session is either kept or not, on every run.
    """
    flagged = F.col("event_type").isin(S.HIGH_VOLUME_TYPES)
    return events.filter(~flagged | (sample_bucket(F.col("session_id")) < percent))
