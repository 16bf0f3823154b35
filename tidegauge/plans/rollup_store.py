"""Stored daily rollups with exact, mergeable distinct counts.

``add_days`` takes the events of whole days, all projects. It adds the ids it has not seen to the dictionaries, then
replaces the days' counts and bitmaps; the same days again give the same tables. A failure leaves at most ids without a
day, which keep their numbers. Days, months and active users are read from the store alone, never from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions.times import month
from tidegauge.operators import distinct
from tidegauge.sources import tables

_COUNTS = "project_id STRING, date DATE, event_type STRING, count BIGINT"
_IDS = {"sessions": "session_id", "users": "user_id"}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _replace_days(rows: DataFrame, path: str) -> None:
    writer = rows.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date").parquet(path)


def add_days(events: DataFrame, root: str) -> None:
    spark = events.sparkSession
    for name, column in _IDS.items():
        path = f"{root}/codes_{name}"
        distinct.new_codes(events, column, _read(spark, path, distinct.CODES)).write.mode("append").parquet(path)
        _replace_days(distinct.daily_bitmaps(events, column, _read(spark, path, distinct.CODES)), f"{root}/{name}")
    _replace_days(distinct.daily_counts(events), f"{root}/counts")


def _parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bitmaps = [_read(spark, f"{root}/{name}", distinct.BITMAPS) for name in _IDS]
    return _read(spark, f"{root}/counts", _COUNTS), *bitmaps


def daily(spark: SparkSession, root: str) -> DataFrame:
    return distinct.rollup(*_parts(spark, root), F.col("date"))


def monthly(spark: SparkSession, root: str) -> DataFrame:
    return distinct.rollup(*_parts(spark, root), month(F.col("date")).alias("month"))


def active_users(spark: SparkSession, root: str) -> DataFrame:
    """Distinct users per project and month, over all event types."""
    users = _read(spark, f"{root}/users", distinct.BITMAPS)
    return distinct.distinct_counts(users, ["project_id", month(F.col("date")).alias("month")], "active_users")
