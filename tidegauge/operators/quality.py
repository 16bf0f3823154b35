"""Metrics, file health, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge import schemas as S
from tidegauge.functions.running import prefix_scan
from tidegauge.functions.times import month


def metrics_by_minute(outcomes: DataFrame) -> DataFrame:
    """One ``internal_metrics`` row per minute, counting that minute only.

    Latency is averaged over the batches that were let through. Gauges, latencies
    and counters that nothing here feeds, table inserts among them, are 0.
    """
    passed = F.col("code").isNull()
    sent = F.col("accepted") > 0
    minute = F.date_trunc("minute", "received_at").alias("timestamp")
    grouped = outcomes.groupBy(minute).agg(
        F.sum("received").alias("events_received"),
        F.sum("accepted").alias("events_validated"),
        F.sum("rejected").alias("events_failed_validation"),
        F.count("*").alias("batches_received"),
        F.count_if(sent).alias("batches_sent_to_redpanda"),
        F.sum("accepted").alias("events_sent_to_redpanda"),
        F.avg(F.when(passed, F.col("latency_ms"))).alias("_latency"),
    )
    zero = F.lit(0).cast("bigint")
    return grouped.select(
        "timestamp",
        "events_received",
        "events_validated",
        "events_failed_validation",
        "batches_received",
        "batches_sent_to_redpanda",
        "events_sent_to_redpanda",
        zero.alias("redpanda_send_errors"),
        zero.alias("clickhouse_inserts"),
        zero.alias("clickhouse_insert_errors"),
        F.coalesce("_latency", F.lit(0.0)).alias("ingest_latency_mean_ms"),
        F.lit(0.0).alias("redpanda_latency_mean_ms"),
        F.lit(0.0).alias("clickhouse_latency_mean_ms"),
        zero.alias("active_connections"),
        zero.alias("queue_depth"),
        F.lit(0).alias("backpressure_active"),
    )


def cumulative_metrics(per_minute: DataFrame) -> DataFrame:
    """Counters since the start, as a process would report them each minute."""
    renamed = per_minute.withColumnsRenamed({c: f"{c}_delta" for c in S.COUNTERS})
    running = prefix_scan(
        renamed,
        keys=[],
        order=["timestamp"],
        values={c: F.col(f"{c}_delta") for c in S.COUNTERS},
        combine="sum",
    )
    return running.select(*per_minute.columns)


def latency_histogram(latencies: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Counts per bound: the first bound not below the value, overflow in the last.

    One aggregate with a counter per bound, so empty buckets appear with 0.
    """
    value, bounds = F.col(column), S.LATENCY_BOUNDS_MS
    lower = [None, *bounds[:-1]]
    counters = []
    for i, bound in enumerate(bounds):
        inside = F.lit(True) if lower[i] is None else value > lower[i]
        if i < len(bounds) - 1:
            inside = inside & (value <= bound)
        counters.append(F.count_if(inside & value.isNotNull()).alias(f"_{bound}"))
    totals = latencies.agg(*counters, F.count(value).alias("total"), F.sum(value).alias("sum"))
    rows = F.explode(
        F.array(*[F.struct(F.lit(b).cast("bigint").alias("bound_ms"), F.col(f"_{b}").alias("count")) for b in bounds])
    )
    mean = F.when(F.col("total") > 0, F.col("sum") / F.col("total")).otherwise(0.0)
    return totals.select(rows.alias("bucket"), "total", F.coalesce("sum", F.lit(0)).alias("sum"), mean.alias("mean")).select(
        "bucket.bound_ms", "bucket.count", "total", "sum", "mean"
    )


def latency_summary(latencies: DataFrame, keys: list[str], column: str = "latency_ms", accuracy: int | None = None) -> DataFrame:
    """Count, range, mean and percentiles; exact unless an ``accuracy`` is given.

    The exact percentile keeps one counter per distinct value, which whole
    milliseconds bound; use ``accuracy`` for a finer column.
    """
    def at(p: float) -> Column:
        if accuracy is None:
            return F.percentile(column, F.lit(p))
        return F.percentile_approx(column, p, accuracy).cast("double")

    return latencies.groupBy(*keys).agg(
        F.count(column).alias("count"),
        F.min(column).alias("min_ms"),
        F.max(column).alias("max_ms"),
        F.avg(column).alias("mean_ms"),
        at(0.5).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        at(0.99).alias("p99_ms"),
    )


def latency_sketches(latencies: DataFrame, keys: list[str], every: str = "minute", column: str = "latency_ms", k: int = 400) -> DataFrame:
    """Per key and ``every`` of ``received_at``: count, sum, range and a KLL sketch, some kilobytes whatever the rows.

    ``k`` sets the rank error: about 0.7 % for 400.
    """
    time = F.date_trunc(every, "received_at").alias("time")
    value = F.col(column).cast("bigint")
    return latencies.where(value.isNotNull()).groupBy(*keys, time).agg(
        F.count(value).alias("count"),
        F.sum(value).alias("sum"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
        F.kll_sketch_agg_bigint(value, k).alias("sketch"),
    )


def merge_latency_sketches(sketches: DataFrame, keys: list[str], every: str = "day", k: int = 400) -> DataFrame:
    """Longer periods from shorter ones; rows are like those of ``latency_sketches``."""
    return sketches.groupBy(*keys, F.date_trunc(every, "time").alias("time")).agg(
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint("sketch", k).alias("sketch"),
    )


def sketch_summary(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``latency_summary`` from sketches: percentiles are values that occurred, their rank near the one asked for."""
    ranks = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    return sketches.select(
        *keys,
        "count",
        "min_ms",
        "max_ms",
        (F.col("sum") / F.col("count")).alias("mean_ms"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in ranks.items()],
    )


def file_stats(files: DataFrame, small_bytes: int = S.SMALL_FILE_BYTES) -> DataFrame:
    """Data files per table, most first: ``files(table, file, rows, bytes)``, as ``reads.file_sizes`` lists them."""
    return (
        files.groupBy("table")
        .agg(
            F.count("*").alias("files"),
            F.sum("rows").alias("rows"),
            F.sum("bytes").alias("bytes"),
            F.count_if(F.col("bytes") < small_bytes).alias("small_files"),
        )
        .orderBy(F.desc("files"), "table")
    )


def high_file_count(stats: DataFrame, threshold: int = S.HIGH_FILE_COUNT) -> DataFrame:
    """Tables due for compaction: more than ``threshold`` files below the size that counts as small."""
    return stats.filter(F.col("small_files") > threshold)


# --- alerts -----------------------------------------------------------------


def _alert(
    kind: str, key: Column, severity: str, message: Column, time: Column, source: str, fields: dict[str, Column]
) -> list[Column]:
    notification = F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()])
    payload = F.struct(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        F.lit(source).alias("source"),
        notification.alias("notification"),
    )
    return [
        time.alias("timestamp"),
        F.lit(kind).alias("kind"),
        key.cast("string").alias("key"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.to_json(payload).alias("payload"),
    ]


def system_alerts(snapshots: DataFrame, source: str = "event-engine") -> DataFrame:
    """Error rate and backpressure rules over metrics rows; every limit is strict."""
    rate = F.col("events_failed_validation") / F.col("events_received")
    too_many = F.concat(
        F.lit(S.ERROR_RATE_TEXT), F.format_string("%.2f", rate * 100), F.lit("%")
    )
    time = F.col("timestamp")

    def system(message: Column) -> dict[str, Column]:
        return {"message": message, "severity": F.lit("warning")}

    failing = snapshots.filter(
        (F.col("events_received") > S.ERROR_RATE_MIN_EVENTS) & (rate > S.ERROR_RATE_LIMIT)
    ).select(
        *_alert("system_alert", F.lit("error_rate"), "warning", too_many, time, source, system(too_many))
    )
    loaded = F.lit(S.BACKPRESSURE_TEXT)
    pressed = snapshots.filter("backpressure_active > 0").select(
        *_alert("system_alert", F.lit("backpressure"), "warning", loaded, time, source, system(loaded))
    )
    return failing.unionByName(pressed)


def disk_alerts(disks: DataFrame, as_of: Column, source: str = "event-engine") -> DataFrame:
    """Nearly full disks."""
    used = 100 - F.col("free_space") / F.col("total_space") * 100
    return disks.filter((F.col("total_space") > 0) & (used > S.DISK_USAGE_LIMIT_PCT)).select(
        *_alert(
            "disk_usage",
            F.col("name"),
            "warning",
            F.lit(S.DISK_USAGE_TEXT),
            as_of,
            source,
            {
                "disk_name": F.col("name"),
                "usage_percent": F.round(used, 2),
                "free_gb": F.floor(F.col("free_space") / 1_000_000_000).cast("bigint"),
            },
        )
    )


def alerts(snapshots: DataFrame, disks: DataFrame, as_of: Column, source: str = "event-engine") -> DataFrame:
    """All alert rules as one table."""
    return system_alerts(snapshots, source).unionByName(disk_alerts(disks, as_of, source))


def tenant_alerts(
    outcomes: DataFrame,
    mau: DataFrame,
    oldest: DataFrame,
    as_of: Column,
    quota_percent: float = 80.0,
    warn_days: int = 7,
) -> DataFrame:
    """Per-project error rate, quota and retention warnings.

    ``mau(project_id, active_users, mau_limit)`` holds the month to judge and
    ``oldest(project_id, oldest_at, raw_hours)`` the oldest raw row. Rates are
    judged like the system rule; quota warns from ``quota_percent`` on;
    retention within ``warn_days`` of expiry.
    """
    by_project = outcomes.groupBy("project_id").agg(
        F.sum("received").alias("received"), F.sum("rejected").alias("rejected")
    )
    rate = F.col("rejected") / F.col("received")
    none_long, none_double = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def row(kind: str, value: Column, threshold: Column, days: Column) -> list[Column]:
        return [
            F.lit(kind).alias("kind"),
            F.col("project_id").alias("tenant_id"),
            value.alias("value"),
            threshold.alias("threshold"),
            days.alias("days_remaining"),
        ]

    errors = by_project.filter(
        (F.col("received") > S.ERROR_RATE_MIN_EVENTS) & (rate > S.ERROR_RATE_LIMIT)
    ).select(*row("high_error_rate", rate, F.lit(S.ERROR_RATE_LIMIT), none_long))
    usage = F.col("active_users") / F.col("mau_limit") * 100
    quota = mau.filter((F.col("mau_limit") > 0) & (usage >= quota_percent)).select(
        *row("quota_warning", usage, F.lit(quota_percent), none_long)
    )
    left_ms = F.col("raw_hours") * 3_600_000 - (F.unix_millis(as_of) - F.unix_millis("oldest_at"))
    days = F.floor(left_ms / 86_400_000).cast("bigint")
    expiring = oldest.filter(days.between(0, warn_days)).select(
        *row("retention_warning", none_double, F.lit(float(warn_days)), days)
    )
    return reduce(DataFrame.unionByName, [errors, quota, expiring])


def alert_cooldown(found: DataFrame, minutes: int) -> DataFrame:
    """Keep an alert only if the one before it of the same kind and key is older than ``minutes``."""
    before = F.lag("timestamp").over(Window.partitionBy("kind", "key").orderBy("timestamp"))
    gap = F.expr(f"INTERVAL {minutes} MINUTES")
    return (
        found.withColumn("_before", before)
        .filter(F.col("_before").isNull() | (F.col("timestamp") - gap > F.col("_before")))
        .drop("_before")
    )


def oldest_rows(events: DataFrame, policies: DataFrame) -> DataFrame:
    """Oldest raw event per project with the hours its project keeps raw rows."""
    first = events.groupBy("project_id").agg(F.min("timestamp").alias("oldest_at"))
    return first.join(policies.select("project_id", "raw_hours"), "project_id")


def current_month(mau: DataFrame, as_of: Column) -> DataFrame:
    return mau.filter(F.col("month") == month(as_of))
