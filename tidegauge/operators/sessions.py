"""Sessions: by SDK session id, and by inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions import variants as V
from tidegauge.schemas import SESSION_TIMEOUT_MINUTES

_EDGE = ["timestamp", "event_id", "url", "path", "referrer", "device_type", "browser", "os", "country"]


def sessions(events: DataFrame, as_of: Column) -> DataFrame:
    """One row per SDK session.

    Only aggregates that combine on the map side: the first and last event are
    the min and max of a struct ordered by (timestamp, event_id), so a session
    with very many events never gathers in one task.
    """
    kind = F.col("event_type")
    depth = F.when(
        kind == "scroll",
        F.coalesce(
            *[V.double(F.try_parse_json("data"), f"$.{p}") for p in ("depth", "scroll_depth", "scrollDepth")]
        ),
    )
    edge = F.struct(*_EDGE)
    user = F.struct("timestamp", "event_id", "user_id")
    grouped = events.groupBy("project_id", "session_id").agg(
        F.min(edge).alias("entry"),
        F.max(edge).alias("exit"),
        F.min(F.when(F.col("user_id").isNotNull(), user)).alias("user"),
        F.count("*").alias("event_count"),
        F.count_if(kind == "pageview").alias("pageview_count"),
        F.count_if(kind == "click").alias("click_count"),
        F.max(depth).alias("scroll_max_depth"),
    )
    duration = F.unix_millis("exit.timestamp") - F.unix_millis("entry.timestamp")
    return grouped.select(
        "session_id",
        "project_id",
        F.col("user.user_id").alias("user_id"),
        F.col("entry.timestamp").alias("started_at"),
        F.col("exit.timestamp").alias("ended_at"),
        "event_count",
        duration.alias("duration_ms"),
        F.col("entry.url").alias("entry_url"),
        F.col("entry.path").alias("entry_path"),
        F.col("exit.url").alias("exit_url"),
        F.col("exit.path").alias("exit_path"),
        F.col("entry.referrer").alias("referrer"),
        "pageview_count",
        "click_count",
        "scroll_max_depth",
        F.col("entry.device_type").alias("device_type"),
        F.col("entry.browser").alias("browser"),
        F.col("entry.os").alias("os"),
        F.col("entry.country").alias("country"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def activity(events: DataFrame, keys: list[str], minutes: int = SESSION_TIMEOUT_MINUTES) -> DataFrame:
    """First, last and number of events per key and ``minutes``-wide slot.

    Events in one slot are never more than the timeout apart, so a slot always
    belongs to a single visit. This shrinks the input of both visit operators
    before the shuffle, to at most one row per key, slot and task.
    """
    slot = F.window("timestamp", f"{minutes} minutes").getField("start").alias("slot")
    return events.groupBy(*keys, slot).agg(
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count("*").alias("events")
    )


def sessionize(
    events: DataFrame, keys: list[str], as_of: Column, minutes: int = SESSION_TIMEOUT_MINUTES
) -> DataFrame:
    """Visits: a new one starts after more than ``minutes`` without an event.

    ``active`` is false once the timeout has passed at ``as_of``.
    """
    by_time = Window.partitionBy(*keys).orderBy("slot")
    gap = F.expr(f"INTERVAL {minutes} MINUTES")
    starts = F.coalesce(F.col("first_at") - gap > F.lag("last_at").over(by_time), F.lit(True))
    numbered = (
        activity(events, keys, minutes)
        .withColumn("_starts", starts.cast("int"))
        .withColumn("visit", F.sum("_starts").over(by_time))
    )
    visits = numbered.groupBy(*keys, "visit").agg(
        F.min("first_at").alias("started_at"),
        F.max("last_at").alias("last_active_at"),
        F.sum("events").alias("event_count"),
    )
    return visits.select(
        *keys,
        "visit",
        "started_at",
        "last_active_at",
        "event_count",
        (F.unix_millis("last_active_at") - F.unix_millis("started_at")).alias("duration_ms"),
        (as_of - gap <= F.col("last_active_at")).alias("active"),
    )


def session_windows(events: DataFrame, keys: list[str], minutes: int = SESSION_TIMEOUT_MINUTES) -> DataFrame:
    """The same visits from Spark's session window, fed with slots instead of events.

    A slot's window lasts from its first event to the timeout after its last.
    """
    width = (F.unix_micros("last_at") - F.unix_micros("first_at")) / 1_000_000 + minutes * 60
    gap = F.make_interval(secs=width.cast("decimal(18,6)"))
    window = F.session_window(F.col("first_at"), gap)
    merged = activity(events, keys, minutes).groupBy(*keys, window).agg(
        F.min("first_at").alias("started_at"),
        F.max("last_at").alias("last_active_at"),
        F.sum("events").alias("event_count"),
    )
    return merged.select(*keys, "started_at", "last_active_at", "event_count")


def latest_sessions(versions: DataFrame) -> DataFrame:
    """Newest version of each session row by ``updated_at``.

    The rank filter is applied per partition before the shuffle, so many
    versions of one session do not meet in one task.
    """
    newest = Window.partitionBy("project_id", "session_id").orderBy(F.desc("updated_at"), F.desc("event_count"))
    return versions.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
