"""Streaming queries over the source events, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from tidegauge.operators import routing
from tidegauge.session import configure, shared_dir
from tidegauge.plans import loading
from tidegauge.sources import broker, tables
from tidegauge.streaming import hours, ingest, sessions, sinks, windows
from workload import adapters as A, sql as Q
from workload.queries import faulty_records, register

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
STORED = ", ".join(p for p in S.TABLES["events"].split(",") if "created_at" not in p)


def source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return broker.file_stream(spark, sf_dir, EVENTS, pathGlobFilter="events.parquet")


def flat_stream(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    return A.flat(A.base(source_stream(spark, sf_dir)), typed)


def _ingested(spark: SparkSession, records: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    root = shared_dir(spark, name)
    query = ingest.ingest_stream(records, f"{root}/events", f"{root}/quarantine", f"{root}/checkpoint", once=True)
    sinks.run_to_end(query)
    stored = sinks.read_epochs(spark, f"{root}/events", f"{STORED}, month STRING")
    rejected = sinks.read_epochs(spark, f"{root}/quarantine", "value STRING, reason STRING")
    return stored.drop("epoch", "month"), rejected.drop("epoch")


_COLUMNS = ", ".join(c for c in Q.ENRICHED_LIST.split(", ") if c not in ("timestamp", "created_at"))


@register(
    "stream_ingest_events",
    f"WITH {Q.flat()} SELECT {_COLUMNS}, make_timestamp(ms * 1000) AS timestamp, {Q.AGENT} FROM f",
)
def stream_ingest_events(spark, sf_dir):
    records = routing.broker_records(flat_stream(spark, sf_dir))
    return _ingested(spark, records, "ingest")[0]


@register(
    "stream_load_events",
    f"""WITH {Q.flat()} SELECT {_COLUMNS}, make_timestamp(ms * 1000) AS timestamp, {Q.AGENT}, r.*
    FROM f, (SELECT count(*)::BIGINT AS ledger_rows FROM f) r""",
)
def stream_load_events(spark, sf_dir):
    """Stream, load, read the table. The micro-batch lands a second time, as after a crash, and is not loaded again."""
    root = shared_dir(spark, "load")
    database = tables.fresh_database(spark, "stream_load", f"{root}/database")
    records = routing.broker_records(flat_stream(spark, sf_dir))
    for turn in range(2):
        query = ingest.ingest_stream(
            records, f"{root}/events", f"{root}/quarantine", f"{root}/checkpoint-{turn}", once=True
        )
        sinks.run_to_end(query)
        loading.load_epochs(spark, f"{root}/events", database)
    ledger = spark.table(f"{database}.{loading.LEDGER}").agg(F.sum("landed_rows").alias("ledger_rows"))
    return spark.table(f"{database}.events").drop("month", "created_at").crossJoin(F.broadcast(ledger))


@register(
    "stream_quarantine",
    f"""WITH {Q.flat()} SELECT 'malformed' AS reason, count(*)::BIGINT AS records
    FROM f WHERE eid % 13 = 0 OR eid % 17 = 0 GROUP BY 1""",
)
def stream_quarantine(spark, sf_dir):
    rejected = _ingested(spark, faulty_records(flat_stream(spark, sf_dir)), "quarantine")[1]
    return rejected.groupBy("reason").agg(F.count("*").alias("records"))


@register("stream_dedupe_events", f"WITH {Q.flat()} SELECT event_id, project_id, event_type, timestamp FROM f")
def stream_dedupe_events(spark, sf_dir):
    """Every third event delivered twice, deduplicated in the stream."""
    root = shared_dir(spark, "dedupe")
    copies = F.when(F.crc32("event_id") % 3 == 0, 2).otherwise(1)
    delivered = flat_stream(spark, sf_dir).withColumn("_n", F.explode(F.sequence(F.lit(1), copies)))
    rows = ingest.dedupe_stream(delivered).select("event_id", "project_id", "event_type", "timestamp")
    sinks.run_to_end(windows.write_updates(rows, f"{root}/rows", f"{root}/checkpoint", "append", once=True))
    schema = "event_id STRING, project_id STRING, event_type STRING, timestamp TIMESTAMP"
    return sinks.read_epochs(spark, f"{root}/rows", schema).drop("epoch")


@register(
    "stream_hourly_rollup",
    f"WITH {Q.flat()} SELECT date_trunc('hour', timestamp) AS hour, project_id, event_type, count(*)::BIGINT AS count FROM f GROUP BY 1, 2, 3",
)
def stream_hourly_rollup(spark, sf_dir):
    """Update mode: an hour that is still open is stored too, and its newest count is read."""
    root = shared_dir(spark, "hourly")
    counts = windows.hourly_counts(flat_stream(spark, sf_dir))
    sinks.run_to_end(windows.write_updates(counts, f"{root}/rows", f"{root}/checkpoint", "update", once=True))
    rows = sinks.read_epochs(
        spark, f"{root}/rows", "hour TIMESTAMP, project_id STRING, event_type STRING, count BIGINT"
    )
    return sinks.newest_per_key(rows, ["hour", "project_id", "event_type"])


@register(
    "stream_hourly_late",
    f"""WITH {Q.flat()} SELECT date_trunc('hour', timestamp) AS hour, project_id, event_type, count(*)::BIGINT AS count,
    count_if(timestamp < TIMESTAMP '2024-01-16' AND timestamp < (SELECT max(timestamp) FROM f) - INTERVAL 24 HOURS)::BIGINT AS late
    FROM f GROUP BY 1, 2, 3""",
)
def stream_hourly_late(spark, sf_dir):
    """The newer half of the events first, then the older one: late rows correct their hours. Summed up in between."""
    root, source = shared_dir(spark, "late"), A.table(spark, sf_dir, "events")
    for part in (source.filter("ts >= '2024-01-16'"), source.filter("ts < '2024-01-16'")):
        part.write.mode("append").parquet(f"{root}/source")
        events = A.flat(A.base(broker.file_stream(spark, f"{root}/source", EVENTS)))
        sinks.run_to_end(hours.hourly_increments(events, f"{root}/hours", f"{root}/checkpoint", once=True))
        hours.compact(spark, f"{root}/hours")
    return hours.hourly_totals(spark, f"{root}/hours")


_VISITS = f"""{Q.BASE}, v0 AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts
        FROM b WINDOW w AS (PARTITION BY project_id, uid ORDER BY ts, eid)),
    v1 AS (SELECT *, sum(starts) OVER (PARTITION BY project_id, uid ORDER BY ts, eid ROWS UNBOUNDED PRECEDING) AS visit FROM v0)"""


@register(
    "stream_sessions",
    f"""WITH {_VISITS}
    SELECT project_id, uid::VARCHAR AS uid, min(ts) AS started_at, max(ts) AS last_active_at, count(*)::BIGINT AS event_count
    FROM v1 GROUP BY project_id, uid, visit
    HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 24 HOURS FROM b)""",
)
def stream_sessions(spark, sf_dir):
    """Closed visits only: the rest stays in the query's state until the watermark passes."""
    root = shared_dir(spark, "sessions")
    rows = flat_stream(spark, sf_dir).withColumn("uid", F.split_part("session_id", F.lit("-"), F.lit(2)))
    closed = windows.closed_sessions(rows, ["project_id", "uid"])
    sinks.run_to_end(windows.write_updates(closed, f"{root}/rows", f"{root}/checkpoint", "append", once=True))
    return sinks.read_epochs(
        spark,
        f"{root}/rows",
        "project_id STRING, uid STRING, started_at TIMESTAMP, last_active_at TIMESTAMP, event_count BIGINT",
    ).drop("epoch")


@register(
    "stream_sessions_stateful",
    f"""WITH {Q.flat(typed=True)}, s AS (
        SELECT *, ms // 1000 AS sec, bool_or(event_type = 'session_end') OVER (PARTITION BY project_id, session_id, ms // 1000) AS last_sec
        FROM f), s0 AS (
        SELECT *, CASE WHEN ms - lag(ms) OVER w <= 1800000 AND NOT (lag(last_sec) OVER w AND lag(sec) OVER w <> sec)
                  THEN 0 ELSE 1 END AS starts
        FROM s WINDOW w AS (PARTITION BY project_id, session_id ORDER BY ms, eid)),
    s1 AS (SELECT *, sum(starts) OVER (PARTITION BY project_id, session_id ORDER BY ms, eid ROWS UNBOUNDED PRECEDING) AS visit FROM s0),
    s2 AS (SELECT project_id, session_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*)::BIGINT AS event_count,
                  bool_or(event_type = 'session_end') AS ended FROM s1 GROUP BY project_id, session_id, visit)
    SELECT project_id, session_id, make_timestamp(first_ms * 1000) AS started_at, make_timestamp(last_ms * 1000) AS last_active_at,
           event_count, last_ms - first_ms AS duration_ms, CASE WHEN ended THEN 'ended' ELSE 'timeout' END AS end_reason
    FROM s2 WHERE CASE WHEN ended THEN (last_ms // 1000 + 1) * 1000 ELSE last_ms + 1800001 END <= (SELECT max(ms) FROM f) - 86400000""",
)
def stream_sessions_stateful(spark, sf_dir):
    root = shared_dir(spark, "stateful")
    closed = sessions.stateful_sessions(flat_stream(spark, sf_dir, typed=True))
    sinks.run_to_end(windows.write_updates(closed, f"{root}/rows", f"{root}/checkpoint", "append", once=True))
    return sinks.read_epochs(
        spark,
        f"{root}/rows",
        "project_id STRING, session_id STRING, started_at TIMESTAMP, last_active_at TIMESTAMP, "
        "event_count BIGINT, duration_ms BIGINT, end_reason STRING",
    ).drop("epoch")
