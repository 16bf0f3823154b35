"""The batch ingestion plan: raw request bodies to accepted rows, quarantine and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegauge.operators import enrich, flatten, outcomes, payload, rules


def validate_batches(raw: DataFrame, key_style: str = "snake", **limits: int) -> DataFrame:
    """One row per event, with its flat columns and the ``error`` it fails with.

    Narrow from end to end: parse, all-or-nothing decode, explode, validate.
    """
    parsed = payload.parse_batches(raw, key_style=key_style, **limits)
    return rules.validate_events(flatten.typed_events(payload.explode_events(parsed)))


def accepted_events(raw: DataFrame, key_style: str = "snake", with_user_agent: bool = False) -> DataFrame:
    """Rows for the ``events`` table."""
    rows = flatten.flat_rows(validate_batches(raw, key_style))
    return enrich.enrich_user_agent(rows) if with_user_agent else rows


def quarantined(raw: DataFrame, key_style: str = "snake") -> DataFrame:
    return outcomes.quarantine(validate_batches(raw, key_style))


def outcomes_by_batch(raw: DataFrame, key_style: str = "snake", **limits: int) -> DataFrame:
    return outcomes.batch_outcomes(payload.parse_batches(raw, key_style=key_style, **limits))
