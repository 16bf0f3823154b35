"""Broker records to the events table, with a quarantine for records that do not fit."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.times import month
from tidegauge.operators.enrich import enrich_user_agent
from tidegauge.sources import broker
from tidegauge.streaming.sinks import BACKOFF_SECONDS, RETRIES, remove_epoch, with_retries, write_epoch
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def dedupe_stream(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Drop re-delivered events; state lasts as long as late events are accepted."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["project_id", "event_id"])


def ingest_stream(
    records: DataFrame,
    events_path: str,
    quarantine_path: str,
    checkpoint: str,
    on_failure: str = "replay",
    once: bool = False,
    interval: str = "1 second",
    retries: int = RETRIES,
    backoff: float = BACKOFF_SECONDS,
) -> StreamingQuery:
    """Decode, enrich and store each micro-batch; ``loading.load_epochs`` moves them into the events table.

    A failed write is repeated ``retries`` times with growing waits. Then the query stops, and Spark replays the
    micro-batch from the checkpoint; with ``on_failure="quarantine"`` the records go to the quarantine instead, with the
    number of attempts, and the query continues. Every folder written belongs to one micro-batch, so neither a repeated
    write nor a replay duplicates rows.
    """
    if on_failure not in ("replay", "quarantine"):
        raise ValueError(f"unknown on_failure {on_failure}")
    values = records.select("value")

    def store(batch: DataFrame, epoch: int) -> None:
        decoded = broker.decode_records(batch).persist()
        try:
            rows = enrich_user_agent(broker.good_records(decoded))
            rows = rows.withColumns({"month": month(F.col("timestamp")), "created_at": F.current_timestamp()})
            bad = broker.bad_records(decoded).withColumns({"reason": F.lit("malformed"), "attempts": F.lit(0)})
            try:
                with_retries(lambda: write_epoch(rows, events_path, epoch, ["month"]), retries, backoff)
            except Exception:
                if on_failure == "replay":
                    raise
                log.exception("micro-batch %s goes to the quarantine", epoch)
                remove_epoch(decoded.sparkSession, events_path, epoch)
                bad = decoded.select("value").withColumns({"reason": F.lit("write failed"), "attempts": F.lit(retries + 1)})
            with_retries(lambda: write_epoch(bad, quarantine_path, epoch), retries, backoff)
        finally:
            decoded.unpersist()

    writer = values.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def validate_stream(
    raw: DataFrame, events_path: str, quarantine_path: str, checkpoint: str, once: bool = False, interval: str = "1 second"
) -> StreamingQuery:
    """Request bodies straight to the events table and the quarantine."""
    from tidegauge.operators import flatten, outcomes
    from tidegauge.plans.ingest import validate_batches

    def store(batch: DataFrame, epoch: int) -> None:
        validated = validate_batches(batch).persist()
        try:
            rows = enrich_user_agent(flatten.flat_rows(validated)).withColumn("month", month(F.col("timestamp")))
            write_epoch(rows, events_path, epoch, ["month"])
            write_epoch(outcomes.quarantine(validated), quarantine_path, epoch)
        finally:
            validated.unpersist()

    writer = raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()
