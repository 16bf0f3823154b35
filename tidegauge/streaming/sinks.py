"""Replay-safe sinks for micro-batches."""

from __future__ import annotations

import logging
from collections.abc import Callable
from time import sleep

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegauge.sources import tables

log = logging.getLogger(__name__)

#: Retries of a failed write, and the wait before the first; the second waits twice as long, and so on.
RETRIES, BACKOFF_SECONDS = 3, 0.1


def write_epoch(rows: DataFrame, path: str, epoch: int, partition_by: list[str] | None = None) -> None:
    """Write a micro-batch under its own folder; a replay overwrites the same folder."""
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/epoch={epoch}")


def remove_epoch(spark: SparkSession, path: str, epoch: int) -> None:
    """Remove what a failed write of a micro-batch left."""
    tables.remove_folder(spark, f"{path}/epoch={epoch}")


def with_retries(write: Callable[[], None], retries: int = RETRIES, backoff: float = BACKOFF_SECONDS) -> int:
    """Run a repeatable write until it succeeds; the number of attempts. The last error is raised."""
    for attempt in range(1, retries + 2):
        try:
            write()
            return attempt
        except Exception:
            if attempt > retries:
                raise
            log.warning("write failed, attempt %s of %s", attempt, retries + 1, exc_info=True)
            sleep(backoff * attempt)
    raise AssertionError("unreachable")


def read_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All micro-batches written so far. An empty table if there is none."""
    return spark.read.schema(f"{schema}, epoch BIGINT").parquet(path)


def newest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted version of each key of an update-mode query."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("epoch"))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "epoch")


def run_to_end(query) -> None:
    """Wait for an ``availableNow`` query and raise its error, if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
