"""Finished micro-batches into the ``events`` table, each exactly once.

A stream lands every micro-batch in a folder of its own, ``<path>/epoch=N``. A load takes the finished folders that the
ledger table does not list:

1. stage: their rows are written under ``<table>/_loading/<load>``, hidden from readers, with the list of their epochs;
2. publish: the staged files are renamed into the month partitions, under names that start with the load;
3. commit: the epochs are appended to the ledger;
4. clean up: staged and landed folders are removed.

A crash at any point is repaired by the next call. A load without a finished stage is dropped and done again; a staged
one goes on at its second step, where files already published are no longer in the stage. Epochs in the ledger are never
taken again, so neither a replayed micro-batch nor a crash before the clean-up repeats rows.

A load reads the landed folders and the ledger rows of their epochs; the months of ``events`` are not read, whatever
their size. Files appear whole, a load's files one after another. One loader per stream at a time. A stream that starts
over with an empty checkpoint numbers its epochs anew: give it another ``stream`` name.
"""

from __future__ import annotations

import logging
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from tidegauge.functions.times import month
from tidegauge.operators.dedupe import dedupe_events
from tidegauge.sources import tables

log = logging.getLogger(__name__)

LEDGER = "epoch_ledger"
_LEDGER_COLUMNS = "stream STRING, epoch BIGINT, load STRING, landed_rows BIGINT, loaded_at TIMESTAMP"
_STAGES = "_loading"


def create_ledger(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{LEDGER} ({_LEDGER_COLUMNS}) USING parquet")


def landed_epochs(spark: SparkSession, path: str) -> dict[int, str]:
    """Finished micro-batches of a stream: number and folder."""
    folders = tables.finished_folders(spark, path, "epoch=")
    return {int(folder.rstrip("/").rsplit("epoch=", 1)[1]): folder for folder in folders}


def ledger_epochs(spark: SparkSession, database: str, stream: str, epochs: list[int]) -> set[int]:
    """Which of some epochs are loaded."""
    rows = spark.table(f"{database}.{LEDGER}").where((F.col("stream") == stream) & F.col("epoch").isin(epochs))
    return {r["epoch"] for r in rows.select("epoch").distinct().collect()}


def landed_rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """Rows of landed folders with their ``epoch``."""
    schema = f"{S.TABLES['events']}, month STRING, epoch BIGINT"
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def load_epochs(
    spark: SparkSession, path: str, database: str, stream: str = "events", dedupe: bool = False
) -> list[int]:
    """Load what a stream has landed; returns the epochs loaded now, those of a load that had failed included.

    ``dedupe`` merges copies of an event (project and id) within the load; all rows are kept without it.
    """
    create_ledger(spark, database)
    location = tables.location(spark, database, "events")
    loaded = resume(spark, path, database, stream, location)
    landed = landed_epochs(spark, path)
    done = ledger_epochs(spark, database, stream, sorted(landed)) if landed else set()
    fresh = sorted(set(landed) - done)
    if fresh:
        load = f"{stream}-{uuid4().hex}"
        stage(spark, path, [landed[e] for e in fresh], fresh, f"{location}/{_STAGES}/{load}", dedupe)
        finish(spark, database, stream, location, load)
    for epoch in landed:
        tables.remove_folder(spark, landed[epoch])
    return sorted(loaded + fresh)


def stage(spark: SparkSession, path: str, folders: list[str], epochs: list[int], folder: str, dedupe: bool) -> None:
    """Write the rows of some micro-batches, and what they are, where readers do not look."""
    rows = landed_rows(spark, path, folders)
    counts = rows.groupBy("epoch").agg(F.count(F.lit(1)).alias("landed_rows"))
    listed = spark.createDataFrame([(e,) for e in epochs], "epoch BIGINT").join(counts, "epoch", "left")
    listed.select("epoch", F.coalesce("landed_rows", F.lit(0)).alias("landed_rows")).coalesce(1).write.parquet(
        f"{folder}/epochs"
    )
    events = rows.select(*[n for n, _ in tables.columns_of("events")])
    events = dedupe_events(events) if dedupe else events
    # Many small files become few, balanced by size.
    balanced = events.withColumn("month", month(F.col("timestamp"))).hint("rebalance", "month")
    balanced = balanced.sortWithinPartitions("month", *S.SORT_KEYS["events"])
    balanced.write.partitionBy("month").parquet(f"{folder}/rows")


def resume(spark: SparkSession, path: str, database: str, stream: str, location: str) -> list[int]:
    """Finish or drop what an earlier call left; returns the epochs it finished."""
    loaded: list[int] = []
    for folder in tables.folders(spark, f"{location}/{_STAGES}", f"{stream}-*"):
        load = folder.rstrip("/").rsplit("/", 1)[1]
        if tables.exists(spark, f"{folder}/rows/_SUCCESS"):
            log.info("load %s goes on", load)
            loaded += finish(spark, database, stream, location, load)
        else:
            tables.remove_folder(spark, folder)
    return loaded


def finish(spark: SparkSession, database: str, stream: str, location: str, load: str) -> list[int]:
    """Publish and commit a staged load. Each step may have been done before."""
    folder = f"{location}/{_STAGES}/{load}"
    publish(spark, database, location, load)
    staged = spark.read.schema("epoch BIGINT, landed_rows BIGINT").parquet(f"{folder}/epochs")
    epochs = [r["epoch"] for r in staged.select("epoch").collect()]
    if set(epochs) - ledger_epochs(spark, database, stream, epochs):
        commit(staged, database, stream, load)
    else:
        epochs = []
    tables.remove_folder(spark, folder)
    return epochs


def publish(spark: SparkSession, database: str, location: str, load: str) -> None:
    """Rename the staged files into their months."""
    for folder in tables.folders(spark, f"{location}/{_STAGES}/{load}/rows", "month=*"):
        value = folder.rstrip("/").rsplit("month=", 1)[1]
        for file in tables.folders(spark, folder, "*.parquet"):
            tables.rename(spark, file, f"{location}/month={value}/{load}-{file.rsplit('/', 1)[1]}")
        spark.sql(f"ALTER TABLE {database}.events ADD IF NOT EXISTS PARTITION (month = '{value}')")
    spark.catalog.refreshTable(f"{database}.events")


def commit(staged: DataFrame, database: str, stream: str, load: str) -> None:
    """One file, so all epochs of a load enter the ledger or none."""
    rows = staged.select(
        F.lit(stream).alias("stream"), "epoch", F.lit(load).alias("load"), "landed_rows", F.current_timestamp().alias("loaded_at")
    )
    rows.coalesce(1).write.mode("append").insertInto(f"{database}.{LEDGER}")
