"""What became of each batch and each rejected event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.once import with_columns_once
from tidegauge.operators.flatten import item_column
from tidegauge.operators.payload import http_status
from tidegauge.operators.rules import event_error


def error_message(idx: Column, reason: Column) -> Column:
    return F.concat(
        F.lit("validation error: event["), idx.cast("string"), F.lit("]: validation error: "), reason
    )


def quarantine(validated: DataFrame) -> DataFrame:
    """Every rejected event, and one row for every batch rejected whole."""
    by_batch = F.col("code").isNotNull()
    return validated.filter(by_batch | F.col("error").isNotNull()).select(
        "batch_id",
        "project_id",
        F.col("idx").cast("bigint").alias("idx"),
        "event_id",
        F.coalesce("code", F.lit("VALID_001")).alias("code"),
        F.when(by_batch, F.lit("batch rejected")).otherwise(error_message(F.col("idx"), F.col("error"))).alias("error"),
        F.when(by_batch, F.col("body")).otherwise(F.to_json("event")).alias("payload"),
        "received_at",
    )


def batch_outcomes(parsed: DataFrame) -> DataFrame:
    """One row per parsed batch: counts, code, status and the messages of its rejected events.

    Taken on the array of events, so nothing is shuffled and a batch that was delivered twice keeps both rows.
    """
    errors = F.transform(
        "events",
        lambda item, idx: F.struct(
            idx.alias("idx"), event_error(lambda name: item_column(item, name)).alias("error")
        ),
    )
    found = F.filter(errors, lambda e: e["error"].isNotNull())
    messages = F.coalesce(F.transform(found, lambda e: error_message(e["idx"], e["error"])), F.array().cast("array<string>"))
    decided = with_columns_once(parsed, {"code": F.col("code"), "errors": messages}).drop("events")
    rejected = F.size("errors").cast("bigint")
    passed = F.col("code").isNull()
    measured = [c for c in ("latency_ms",) if c in parsed.columns]
    return decided.select(
        "batch_id",
        "project_id",
        "received_at",
        "shape",
        "received",
        F.when(passed, F.col("received") - rejected).otherwise(0).cast("bigint").alias("accepted"),
        rejected.alias("rejected"),
        "code",
        http_status(F.col("code")).alias("http_status"),
        passed.alias("success"),
        "errors",
        *measured,
    )
