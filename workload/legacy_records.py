"""Legacy tagged events as JSON records, derived from the source events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from workload.adapters import balanced, base_events, pick


def _uuid(text: Column) -> Column:
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid, k, ms, value = F.col("eid"), F.col("k"), F.col("ms"), F.col("value")
    kind = pick(S.LEGACY_TYPES, eid)
    received = F.when(eid % 50 == 0, ms - 6000).when(eid % 53 == 0, ms + 25 * 3600 * 1000).otherwise(ms + 1000)

    def of(name: str, column: Column) -> Column:
        return F.when(kind == name, column)

    metrics = F.struct(
        value.alias("lcp"),
        F.when(eid % 37 == 0, F.lit(11.0)).otherwise(k / 100).alias("cls"),
        k.alias("resource_count"),
        F.col("cents").alias("memory_usage"),
    )
    metadata = F.struct(
        F.lit("agent").alias("user_agent"),
        F.concat(F.lit("10.0.0."), k).alias("ip"),
        F.lit(1280).alias("screen_width"),
        F.lit(2).alias("device_pixel_ratio"),
        F.lit("UTC").alias("timezone"),
        F.when(eid % 46 == 0, F.repeat(F.lit("l"), 17)).otherwise(F.lit("en")).alias("language"),
    )
    record = F.struct(
        F.when(eid % 73 == 0, F.lit("not-a-uuid")).otherwise(_uuid(F.concat(F.lit("e"), eid))).alias("id"),
        _uuid(F.concat(F.lit("t"), F.col("uid") % 7)).alias("tenant_id"),
        _uuid(F.concat(F.lit("s"), F.col("session_id"))).alias("session_id"),
        F.when(eid % 61 == 0, F.repeat(F.lit("u"), 129)).otherwise(F.col("user_id")).alias("user_id"),
        _iso(ms).alias("timestamp"),
        F.when(eid % 3 != 0, _iso(received)).alias("received_at"),
        F.when(eid % 71 == 0, F.lit("unheard_of")).otherwise(kind).alias("type"),
        of("pageview", F.when(eid % 43 == 0, F.repeat(F.lit("t"), 501)).otherwise(F.concat(F.lit("Page "), k))).alias("title"),
        of("pageview", F.concat(F.lit("/p/"), k)).alias("path"),
        of("pageview", F.col("cents")).alias("load_time"),
        of("pageview", F.when(k % 2 == 0, value)).alias("time_to_first_byte"),
        F.when(kind == "click", F.lit("button")).when(kind == "scroll", F.when(k % 2 == 0, F.lit("main"))).alias("element"),
        of("click", F.concat(F.lit("#b"), k)).alias("selector"),
        of("click", F.when(eid % 3 == 0, F.struct(k.alias("x"), value.alias("y")))).alias("coordinates"),
        of("click", F.when(k % 2 == 0, F.lit(True))).alias("is_double_click"),
        of("click", F.lit("Buy")).alias("text"),
        of("scroll", F.when(eid % 41 == 0, k + 101).otherwise(k)).alias("scroll_depth"),
        of("scroll", F.when(k % 2 == 0, F.lit("up")).otherwise(F.lit("down"))).alias("direction"),
        of("performance", metrics).alias("metrics"),
        of("custom", F.col("kind")).alias("event_name"),
        of("custom", F.struct("k")).alias("properties"),
        F.when(eid % 2 == 0, metadata).alias("metadata"),
    )
    rows = base_events(spark, sf_dir).select(
        eid.alias("record_no"),
        F.floor(eid / 20).cast("bigint").alias("batch_id"),
        (eid % 20).alias("idx"),
        F.to_json(record).alias("value"),
        F.timestamp_millis(received).alias("arrived_at"),
    )
    return balanced(rows)
