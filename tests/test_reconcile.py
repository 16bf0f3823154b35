"""Stored rollups follow the events of a declared range, whatever fails on the way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.plans import reconcile
from tidegauge.sources import tables

COLUMNS = "project_id STRING, session_id STRING, user_id STRING, event_type STRING, timestamp TIMESTAMP"
DAY = dt.date(2024, 1, 10)


def day(n):
    return DAY + dt.timedelta(days=n)


def events(spark, *rows):
    """Rows of ``(project, day, type)``, at noon."""
    noon = lambda n: dt.datetime.combine(day(n), dt.time(12))
    data = [(p, f"s{k}", None if k % 2 else "u", kind, noon(n)) for k, (p, n, kind) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


def stored(spark, root, name="daily_rollup"):
    time = "date" if name == "daily_rollup" else F.to_date("hour").alias("date")
    rows = reconcile.read(spark, root, name).select("project_id", time, "event_type", "count").collect()
    return sorted((r["project_id"], (r["date"] - DAY).days, r["event_type"], r["count"]) for r in rows)


BEFORE = [("a", 0, "x"), ("a", 0, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b/c:d*", 1, "x"), ("b/c:d*", 1, "y")]


def test_a_day_without_events_has_no_rollup(spark, tmp_path):
    root = str(tmp_path)
    reconcile.reconcile(events(spark, *BEFORE), root, None, day(0), day(3))
    first = [("a", 0, "x", 2), ("a", 1, "x", 1), ("a", 2, "y", 1), ("b/c:d*", 1, "x", 1), ("b/c:d*", 1, "y", 1)]
    assert stored(spark, root) == stored(spark, root, "hourly_rollup") == first
    # Project a lost a day and a type, and gained a day; day 0 lies outside the range.
    now = events(spark, ("a", 2, "z"), ("a", 3, "x"), ("b/c:d*", 3, "x"))
    reconcile.reconcile(now, root, "a", day(1), day(4))
    want = [("a", 0, "x", 2), ("a", 2, "z", 1), ("a", 3, "x", 1), ("b/c:d*", 1, "x", 1), ("b/c:d*", 1, "y", 1)]
    assert stored(spark, root) == stored(spark, root, "hourly_rollup") == want
    reconcile.reconcile(now, root, "b/c:d*", day(0), day(2))
    assert stored(spark, root) == [("a", 0, "x", 2), ("a", 2, "z", 1), ("a", 3, "x", 1)]
    reconcile.reconcile(events(spark, ("a", 9, "x")).limit(0), root, None, day(0), day(9))
    assert stored(spark, root) == stored(spark, root, "hourly_rollup") == []


@pytest.mark.parametrize("start, end", [(dt.datetime(2024, 1, 10, 6), day(1)), (day(0), dt.datetime(2024, 1, 10, 18))])
def test_part_days_are_refused(spark, tmp_path, start, end):
    with pytest.raises(ValueError):
        reconcile.reconcile(events(spark, *BEFORE), str(tmp_path), None, start, end)
    assert reconcile.whole_days(dt.datetime(2024, 1, 10), day(2)) == [day(0), day(1)]


@pytest.mark.parametrize("function, after", [("rename", 0), ("rename", 1), ("remove_folder", 0), ("remove_folder", 3)])
def test_a_failed_run_is_finished_by_the_next(spark, tmp_path, monkeypatch, function, after):
    root = str(tmp_path)
    reconcile.reconcile(events(spark, *BEFORE), root, None, day(0), day(3))
    now = [("a", 1, "z"), ("b/c:d*", 2, "x")]
    real, calls = getattr(tables, function), []

    def failing(*args):
        calls.append(args)
        if len(calls) == after + 1:
            raise OSError("gone")
        return real(*args)

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(tables, function, failing)
        reconcile.reconcile(events(spark, *now), root, None, day(0), day(3))
    reconcile.finish_earlier(spark, root)
    assert stored(spark, root, "hourly_rollup") == [(*r, 1) for r in now]
    reconcile.reconcile(events(spark, *now), root, None, day(0), day(3))
    assert stored(spark, root) == [(*r, 1) for r in now]
    assert tables.folders(spark, f"{root}/_staging", "*") == []


def test_a_run_that_failed_before_its_list_is_dropped(spark, tmp_path):
    root = str(tmp_path)
    reconcile.reconcile(events(spark, *BEFORE), root, None, day(0), day(3))
    before = stored(spark, root)
    spark.range(1).write.parquet(f"{root}/_staging/daily_rollup-dead/rows")
    reconcile.finish_earlier(spark, root)
    assert stored(spark, root) == before and tables.folders(spark, f"{root}/_staging", "*") == []
