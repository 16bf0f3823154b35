"""Exact distinct counts that merge: ids become dense numbers per project, and numbers become bitmaps.

A dictionary gives every id of a project a number from 0 on, once and for all. A day's ids of a project and type are the
set bits of a few bitmaps, each for a bucket of numbers. Days merge into months, and types into users, by OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.running import prefix_scan

CODES = "project_id STRING, id STRING, code BIGINT"
BITMAPS = "project_id STRING, date DATE, event_type STRING, bucket BIGINT, bitmap BINARY"


def new_codes(events: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``project_id, id, code`` of ids that ``known`` lacks; they follow the project's last code. Null ids have none.

    Numbers come from a prefix scan: a project of any size is numbered by many tasks.
    """
    ids = events.select("project_id", F.col(column).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    fresh = ids.join(known.select("project_id", "id"), ["project_id", "id"], "left_anti")
    numbered = prefix_scan(fresh, ["project_id"], ["id"], {"code": F.lit(1)}, "sum")
    last = known.groupBy("project_id").agg((F.max("code") + 1).alias("used"))
    return numbered.join(last, "project_id", "left").select(
        "project_id", "id", (F.col("code") - 1 + F.coalesce("used", F.lit(0))).alias("code")
    )


def daily_bitmaps(events: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``project_id, date, event_type, bucket, bitmap``: which ids a project had on a day, by event type.

    Ids of a day are made distinct before they meet the dictionary; bits are combined on the map side.
    """
    seen = events.select(
        "project_id", F.to_date("timestamp").alias("date"), "event_type", F.col(column).cast("string").alias("id")
    ).where("id IS NOT NULL")
    coded = seen.distinct().join(codes, ["project_id", "id"])
    # Positions count from 1 in the functions.
    number = F.col("code") + 1
    return coded.groupBy("project_id", "date", "event_type", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap")
    )


def distinct_counts(bitmaps: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """Distinct ids per ``keys``: buckets are merged by OR, then their bits are counted."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    merged = bitmaps.groupBy(*columns, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    names = [c for c in merged.columns if c not in ("bucket", "n")]
    return merged.groupBy(*names).agg(F.sum("n").alias(name))


def daily_counts(events: DataFrame) -> DataFrame:
    """Events per project, day and type."""
    return events.groupBy("project_id", F.to_date("timestamp").alias("date"), "event_type").agg(F.count("*").alias("count"))


def rollup(counts: DataFrame, sessions: DataFrame, users: DataFrame, time: Column) -> DataFrame:
    """Events, sessions and users per project, period and type; ``time`` makes the period of a ``date`` and names it."""
    period = counts.select(time).columns[0]
    keys = ["project_id", period, "event_type"]
    totals = counts.groupBy("project_id", time, "event_type").agg(F.sum("count").alias("count"))
    for rows, name in ((sessions, "unique_sessions"), (users, "unique_users")):
        totals = totals.join(distinct_counts(rows, ["project_id", time, "event_type"], name), keys, "left")
    zero = F.lit(0).cast("bigint")
    return totals.select(*keys, "count", *[F.coalesce(c, zero).alias(c) for c in ("unique_sessions", "unique_users")])
