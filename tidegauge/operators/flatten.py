"""SDK events to the canonical flat row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S
from tidegauge.functions import variants as V
from tidegauge.functions.urls import extract_path


# Where the checked columns of an event are in its ``sdk`` fields.
CHECKED_TEXT = {
    "event_id": "id",
    "session_id": "sessionId",
    "user_id": "userId",
    "event_type": "type",
    "url": "url",
    "given_path": "path",
    "given_referrer": "referrer",
    "user_agent": "userAgent",
}


def item_column(item: Column, name: str) -> Column:
    """A column of ``typed_events`` for an item of the event array; any other is one of the batch."""
    if name in CHECKED_TEXT:
        return item["sdk"][CHECKED_TEXT[name]].cast("string")
    if name == "timestamp_ms":
        return item["sdk"]["timestamp"]
    return item[name] if name in ("data", "payload_error") else F.col(name)


def typed_events(exploded: DataFrame) -> DataFrame:
    """Give every exploded event its flat columns (no validation yet)."""

    def text(path: str) -> Column:
        return F.col(f"sdk.{path}").cast("string")

    def or_unknown(path: str) -> Column:
        return F.coalesce(text(path), F.lit("unknown"))

    return exploded.select(
        *[c for c in exploded.columns if c not in ("sdk", "data", "payload_error")],
        *[text(path).alias(name) for name, path in CHECKED_TEXT.items()],
        F.col("sdk.timestamp").alias("timestamp_ms"),
        or_unknown("deviceInfo.device.type").alias("device_type"),
        or_unknown("deviceInfo.browser.name").alias("browser"),
        or_unknown("deviceInfo.browser.version").alias("browser_version"),
        or_unknown("deviceInfo.device.os").alias("os"),
        or_unknown("location.country").alias("country"),
        text("location.region").alias("region"),
        text("location.city").alias("city"),
        "data",
        "payload_error",
    )


def flat_rows(validated: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Accepted events as rows of the ``events`` table."""
    event = F.col("event")
    custom_name = F.when(
        (F.col("event_type") == "custom") & V.is_type(event, "$.name", "string"), V.text(event, "$.name")
    )
    return validated.filter(F.col("idx").isNotNull() & F.col("error").isNull()).select(
        "event_id",
        "project_id",
        "session_id",
        "user_id",
        "event_type",
        custom_name.alias("custom_name"),
        F.timestamp_millis("timestamp_ms").alias("timestamp"),
        "url",
        F.coalesce("given_path", extract_path(F.col("url"))).alias("path"),
        F.coalesce("given_referrer", F.lit("")).alias("referrer"),
        "user_agent",
        "device_type",
        "browser",
        "browser_version",
        "os",
        "country",
        "region",
        "city",
        "data",
        (F.col("received_at") if created_at is None else created_at).alias("created_at"),
    )


def classify(events: DataFrame) -> DataFrame:
    """Flag trigger and high-volume event types."""
    kind = F.col("event_type")
    return events.withColumns(
        {
            "is_trigger_event": kind.isin(S.TRIGGER_TYPES),
            "is_high_volume": kind.isin(S.HIGH_VOLUME_TYPES),
        }
    )
