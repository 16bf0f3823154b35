"""Rollups of events: daily, hourly, monthly users, rate audit, trigger funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S
from tidegauge.functions.times import month


def daily_rollup(events: DataFrame) -> DataFrame:
    """Events, sessions and users per project, day and type. Null users do not count."""
    return events.groupBy("project_id", F.to_date("timestamp").alias("date"), "event_type").agg(
        F.count("*").alias("count"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
    )


def daily_rollup_approx(events: DataFrame, rsd: float = 0.02) -> DataFrame:
    """The daily rollup in one shuffle, with HyperLogLog++ distinct counts."""
    return events.groupBy("project_id", F.to_date("timestamp").alias("date"), "event_type").agg(
        F.count("*").alias("count"),
        F.approx_count_distinct("session_id", rsd).alias("unique_sessions"),
        F.approx_count_distinct("user_id", rsd).alias("unique_users"),
    )


def daily_sketches(events: DataFrame) -> DataFrame:
    """Daily rollup rows with mergeable sketches in place of distinct counts."""
    return events.groupBy("project_id", F.to_date("timestamp").alias("date"), "event_type").agg(
        F.count("*").alias("count"),
        F.hll_sketch_agg("session_id").alias("session_sketch"),
        F.hll_sketch_agg("user_id").alias("user_sketch"),
    )


def merge_sketches(daily: DataFrame) -> DataFrame:
    """Monthly totals from daily sketches, without going back to the events."""
    return daily.groupBy("project_id", month(F.col("date")).alias("month"), "event_type").agg(
        F.sum("count").alias("count"),
        F.hll_sketch_estimate(F.hll_union_agg("session_sketch")).alias("unique_sessions"),
        F.hll_sketch_estimate(F.hll_union_agg("user_sketch")).alias("unique_users"),
    )


def hourly_rollup(events: DataFrame) -> DataFrame:
    hour = F.window("timestamp", "1 hour").getField("start").alias("hour")
    return events.groupBy(hour, "project_id", "event_type").agg(F.count("*").alias("count"))


def mau_status(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Monthly active users per project against its plan limit (none: never over)."""
    users = events.groupBy("project_id", month(F.col("timestamp")).alias("month")).agg(
        F.count_distinct("user_id").alias("active_users")
    )
    return users.join(limits.select("project_id", F.col("limit").alias("mau_limit")), "project_id", "left").select(
        "project_id",
        "month",
        "active_users",
        "mau_limit",
        F.coalesce(F.col("active_users") > F.col("mau_limit"), F.lit(False)).alias("is_over_limit"),
    )


def tier_value(tier: Column, setting: str) -> Column:
    """Default of a setting for a tier."""
    pairs = [(name, values[setting]) for name, values in S.TIERS.items()]
    case = F.when(tier == pairs[0][0], F.lit(pairs[0][1]))
    return reduce(lambda c, p: c.when(tier == p[0], F.lit(p[1])), pairs[1:], case).cast("bigint")


def rate_limit_audit(events: DataFrame, tenants: DataFrame, every: str = "second") -> DataFrame:
    """Seconds in which a project sent more events than its limit."""
    limits = tenants.select(
        F.col("id").alias("project_id"),
        F.coalesce(F.col("rate_limit").cast("bigint"), tier_value(F.col("tier"), "rate_limit")).alias("rate_limit"),
    )
    per_second = events.groupBy("project_id", F.date_trunc(every, "timestamp").alias("second")).agg(
        F.count("*").alias("events")
    )
    return (
        per_second.join(limits, "project_id")
        .filter(F.col("events") > F.col("rate_limit"))
        .select("project_id", "second", "events", "rate_limit", (F.col("events") - F.col("rate_limit")).alias("excess"))
    )


def trigger_funnel(events: DataFrame) -> DataFrame:
    """Lifecycle counts and rates per project and trigger."""
    stages = [t for t in S.TRIGGER_TYPES if t.startswith("trigger_")]
    rows = events.filter(F.col("event_type").isin(stages)).select(
        "project_id",
        "event_type",
        F.try_variant_get(F.try_parse_json("data"), "$.trigger_id", "string").alias("trigger_id"),
    )
    counts = rows.groupBy("project_id", "trigger_id").agg(
        *[F.count_if(F.col("event_type") == s).alias(s.removeprefix("trigger_")) for s in stages]
    )

    def rate(stage: str) -> Column:
        return F.when(F.col("fired") > 0, F.round(F.col(stage) / F.col("fired"), 4)).alias(f"{stage}_rate")

    return counts.select("*", rate("action"), rate("dismissed"), rate("error"))


def engagement(events: DataFrame) -> DataFrame:
    """Average engagement score and factors per project."""
    doc = F.try_parse_json("data")
    fields = {
        "score": "$.score",
        "time_on_page": "$.factors.time_on_page",
        "scroll_depth": "$.factors.scroll_depth",
        "click_count": "$.factors.click_count",
        "mouse_activity": "$.factors.mouse_activity",
        "focus_time": "$.factors.focus_time",
    }
    rows = events.filter(F.col("event_type") == "engagement_snapshot").withColumn("_doc", doc)
    return rows.groupBy("project_id").agg(
        F.count("*").alias("snapshots"),
        *[F.avg(F.try_variant_get("_doc", path, "double")).alias(f"avg_{name}") for name, path in fields.items()],
    )
