"""Recompute the stored rollups of a declared range of whole days, days that lost their events included.

The range, not the rows, says what is replaced: a project's day without events ends without a rollup. New partitions are
staged, then a list of what is to be replaced and removed is committed, then it is carried out folder by folder. A run
that failed before the list leaves nothing behind; one that failed after it is finished by the next call.
"""

from __future__ import annotations

import datetime as dt
import logging
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions.times import between
from tidegauge.operators import rollups
from tidegauge.sources import tables

log = logging.getLogger(__name__)

TABLES = {
    "hourly_rollup": "hour TIMESTAMP, project_id STRING, event_type STRING, count BIGINT, day DATE",
    "daily_rollup": "project_id STRING, date DATE, event_type STRING, count BIGINT, unique_sessions BIGINT, unique_users BIGINT, day DATE",
}
_STAGES = "_staging"


def whole_days(start: dt.datetime | dt.date, end: dt.datetime | dt.date) -> list[dt.date]:
    """The days from ``start`` up to ``end``, which is not included. Part days are refused."""
    for at in (start, end):
        if isinstance(at, dt.datetime) and at.time() != dt.time():
            raise ValueError(f"{at} is not the start of a day")
    first, last = (at.date() if isinstance(at, dt.datetime) else at for at in (start, end))
    return [first + dt.timedelta(days=k) for k in range((last - first).days)]


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored rollup without its partition column ``day``; empty if there is none."""
    if not tables.exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], TABLES[name]).drop("day")
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}").drop("day")


def _stored_days(spark: SparkSession, folder: str, project_id: str | None, days: list[dt.date]) -> set[str]:
    """Partitions of the range that exist, as paths below ``folder``."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    project = "*" if project_id is None else escape(project_id)
    found = [f for day in days for f in tables.folders(spark, folder, f"project_id={project}/day={day}")]
    return {"/".join(f.rstrip("/").rsplit("/", 2)[1:]) for f in found}


def _stage(rows: DataFrame, time: str, root: str, name: str, project_id: str | None, days: list[dt.date]) -> str:
    """Write the new partitions and the list of what they replace; returns the folder."""
    spark = rows.sparkSession
    folder = f"{root}/{_STAGES}/{name}-{uuid4().hex}"
    dated = rows.withColumn("day", F.to_date(time)).hint("rebalance", "project_id", "day")
    dated.write.partitionBy("project_id", "day").parquet(f"{folder}/rows")
    staged = {"/".join(f.rstrip("/").rsplit("/", 2)[1:]) for f in tables.folders(spark, f"{folder}/rows", "project_id=*/day=*")}
    gone = _stored_days(spark, f"{root}/{name}", project_id, days) - staged
    actions = [(path, "replace") for path in sorted(staged)] + [(path, "remove") for path in sorted(gone)]
    spark.createDataFrame(actions, "path STRING, action STRING").coalesce(1).write.parquet(f"{folder}/actions")
    return folder


def _carry_out(spark: SparkSession, folder: str, root: str) -> None:
    """Do what the list says; what has been done already is passed over."""
    name = folder.rstrip("/").rsplit("/", 1)[1].rsplit("-", 1)[0]
    for row in spark.read.schema("path STRING, action STRING").parquet(f"{folder}/actions").collect():
        new, target = f"{folder}/rows/{row['path']}", f"{root}/{name}/{row['path']}"
        if row["action"] == "remove":
            tables.remove_folder(spark, target)
        elif tables.exists(spark, new):
            tables.remove_folder(spark, target)
            tables.rename(spark, new, target)
    tables.remove_folder(spark, folder)


def finish_earlier(spark: SparkSession, root: str) -> None:
    """Finish or drop what an earlier run left."""
    for folder in tables.folders(spark, f"{root}/{_STAGES}", "*"):
        if tables.exists(spark, f"{folder}/actions/_SUCCESS"):
            log.info("%s goes on", folder)
            _carry_out(spark, folder, root)
        else:
            tables.remove_folder(spark, folder)


def reconcile(
    events: DataFrame, root: str, project_id: str | None, start: dt.datetime | dt.date, end: dt.datetime | dt.date
) -> None:
    """Make the stored hourly and daily rollups of a project, or of all, equal to ``events`` from ``start`` to ``end``."""
    spark, days = events.sparkSession, whole_days(start, end)
    finish_earlier(spark, root)
    if not days:
        return
    scope = events if project_id is None else events.filter(F.col("project_id") == project_id)
    after = days[-1] + dt.timedelta(days=1)
    rows = between(scope, F.lit(str(days[0])).cast("timestamp"), F.lit(str(after)).cast("timestamp"))
    staged = [
        _stage(rollups.hourly_rollup(rows), "hour", root, "hourly_rollup", project_id, days),
        _stage(rollups.daily_rollup(rows), "date", root, "daily_rollup", project_id, days),
    ]
    for folder in staged:
        _carry_out(spark, folder, root)

