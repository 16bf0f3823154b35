"""Request bodies that break each limit in turn, and their outcomes as SQL.

On two days of three, every 16th event breaks the same rule; on the third none does. Bodies over the byte and count
limits come on all days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from workload import sql as Q
from workload.adapters import base_events

VARIANTS = 16
#: variant -> field, its value (SQL for either engine), reason
FAULTS = {
    1: ("url", f"repeat('u', {S.FIELD_MAX_CHARS['url'] + 1})", "url is longer than 2048 characters"),
    2: ("userAgent", f"repeat('a', {S.FIELD_MAX_CHARS['userAgent'] + 1})", "userAgent is longer than 512 characters"),
    3: ("userId", f"repeat('u', {S.FIELD_MAX_CHARS['userId'] + 1})", "userId is longer than 128 characters"),
    4: ("path", f"repeat('p', {S.FIELD_MAX_CHARS['path'] + 1})", "path is longer than 2000 characters"),
    5: ("referrer", f"repeat('r', {S.FIELD_MAX_CHARS['referrer'] + 1})", "referrer is longer than 2048 characters"),
    6: ("id", "''", "id is required"),
    7: ("sessionId", "''", "sessionId is required"),
    8: ("url", "''", "url is required"),
    9: ("userAgent", "''", "userAgent is required"),
    10: ("timestamp", "-9223372036854775808L", "timestamp cannot be more than 24h in the past"),
    11: ("timestamp", "9223372036854775807L", "timestamp cannot be more than 5s in the future"),
    12: ("note", "repeat('n', 20480)", "extra data 20KB exceeds 16KB limit"),
    13: ("note", "repeat('n', 71680)", "extra data 70KB exceeds 16KB limit"),
    14: ("url", f"concat('https://example.com/', repeat('u', {S.FIELD_MAX_CHARS['url'] - 20}))", None),
}
#: The variant that is over the limit of a single event.
HUGE_EVENT = 13


def guard_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One body per source event."""
    eid = F.col("eid")
    variant = F.when(F.dayofmonth("ts") % 3 == 0, 0).otherwise(eid % VARIANTS)

    def field(name: str, usual: Column) -> Column:
        faults = [(v, value) for v, (at, value, _) in FAULTS.items() if at == name]
        return reduce(lambda c, f: F.when(variant == f[0], F.expr(f[1])).otherwise(c), faults, usual).alias(name)

    none = F.lit(None).cast("string")
    event = F.to_json(
        F.struct(
            field("id", F.concat(F.lit("e-"), eid)),
            F.lit("click").alias("type"),
            field("timestamp", F.col("ms")),
            field("sessionId", F.col("session_id")),
            field("url", F.lit("https://example.com/")),
            field("userAgent", F.lit("agent")),
            field("userId", F.col("user_id")),
            field("path", none),
            field("referrer", none),
            field("note", none),
        )
    )
    listed = F.concat(F.lit("["), F.repeat(F.concat("_event", F.lit(",")), F.lit(S.MAX_BATCH_EVENTS)), "_event", F.lit("]"))
    body = (
        F.when(eid % 997 == 0, F.rpad("_event", S.MAX_BATCH_BYTES + 1, " "))
        # Short events only: this one is to be over the count, not over the size.
        .when((eid % 991 == 0) & (F.octet_length("_event") < 1000), listed)
        .otherwise(F.col("_event"))
    )
    return base_events(spark, sf_dir).withColumn("_event", event).select(
        eid.alias("batch_id"), "project_id", body.alias("body"), F.col("ts").alias("received_at")
    )


def guard_outcomes(event_guard: bool = False) -> str:
    """SQL: ``o``, the outcome of every body."""
    reasons = " ".join(f"WHEN {v} THEN '{text}'" for v, (_, _, text) in FAULTS.items() if text)
    long = ", ".join(str(v) for v, (_, value, _) in FAULTS.items() if "repeat" in value and v not in (2, 3))
    huge = f"WHEN v = {HUGE_EVENT} THEN 'VALID_003'" if event_guard else ""
    return f"""{Q.BASE}, g0 AS (
        SELECT *, CASE WHEN day(ts) % 3 = 0 THEN 0 ELSE eid % {VARIANTS} END AS v FROM b), g1 AS (
        SELECT *, eid % 997 = 0 AS big, eid % 997 <> 0 AND eid % 991 = 0 AND v NOT IN ({long}) AS many FROM g0), g2 AS (
        SELECT *, CASE WHEN big OR many THEN 'VALID_002' {huge} END AS code, CASE v {reasons} END AS reason FROM g1)
    , o AS (
        SELECT eid AS batch_id, project_id, ts AS received_at,
               CASE WHEN big THEN NULL WHEN many THEN 'array' ELSE 'single' END AS shape,
               CASE WHEN big THEN 0 WHEN many THEN {S.MAX_BATCH_EVENTS + 1} ELSE 1 END::BIGINT AS received,
               (code IS NULL AND reason IS NULL)::BIGINT AS accepted,
               (code IS NULL AND reason IS NOT NULL)::BIGINT AS rejected,
               code, CASE WHEN code IS NULL THEN 200 ELSE 400 END::BIGINT AS http_status, code IS NULL AS success,
               CASE WHEN code IS NULL AND reason IS NOT NULL
                    THEN 'validation error: event[0]: validation error: ' || reason ELSE '' END AS errors
        FROM g2)"""
