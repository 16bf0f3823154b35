"""Late rows correct stored hours; streamed sessions are merged before the shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import tables
from tidegauge.streaming import hours, sinks, windows

ROW = "event_id STRING, project_id STRING, event_type STRING, timestamp TIMESTAMP"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def batch(spark, *at_hours):
    return spark.createDataFrame([(f"e{n}", "p", "click", at(h)) for n, h in enumerate(at_hours)], ROW)


def totals(spark, path):
    return sorted((r["hour"], r["count"], r["late"]) for r in hours.hourly_totals(spark, path).collect())


WANT = [(at(0), 2, 1), (at(10), 1, 0), (at(40), 3, 0), (at(50), 1, 0)]


def test_late_rows_are_counted_and_correct_their_hour(spark, tmp_path):
    source, path, late, checkpoint = (str(tmp_path / d) for d in ("in", "hours", "late", "checkpoint"))
    for rows in ((0, 10.5), (40, 40.1), (0.2, 40.9, 50)):
        batch(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        sinks.run_to_end(hours.hourly_increments(stream, path, checkpoint, late_path=late, once=True))
    assert totals(spark, path) == WANT
    assert [r["timestamp"] for r in sinks.read_epochs(spark, late, ROW).collect()] == [at(0.2)]


@pytest.mark.parametrize("crash", [False, True])
def test_replays_and_compaction_change_nothing(spark, tmp_path, monkeypatch, crash):
    path = str(tmp_path / "hours")
    assert totals(spark, path) == [] and hours.compact(spark, path) == -1
    batches = [batch(spark, 0, 10.5), batch(spark, 40, 40.1), batch(spark, 0.2, 40.9, 50)]
    for epoch, rows in enumerate(batches):
        for _ in range(2):  # replayed
            hours.store_increment(rows, epoch, path)
        before = totals(spark, path)
        if crash:
            with monkeypatch.context() as patch, pytest.raises(OSError):
                patch.setattr(hours.tables, "remove_folder", lambda *_: (_ for _ in ()).throw(OSError("gone")))
                hours.compact(spark, path)
            assert totals(spark, path) == before
        assert hours.compact(spark, path) == epoch
        hours.store_increment(rows, epoch, path)  # replayed behind the sum
        assert totals(spark, path) == before
    assert totals(spark, path) == WANT
    hours.compact(spark, path)
    assert len(tables.folders(spark, path, "*=*")) == 1


def test_an_empty_micro_batch_keeps_the_mark(spark, tmp_path):
    path = str(tmp_path / "hours")
    for epoch, rows in enumerate([batch(spark, 50), batch(spark, 50).limit(0), batch(spark, 1)]):
        hours.store_increment(rows, epoch, path)
    assert totals(spark, path) == [(at(1), 1, 1), (at(50), 1, 0)]


def test_a_hot_key_sends_sessions_not_events(spark, tmp_path):
    """100,000 events of one key in four partitions reach the state as a few sessions a partition."""
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    events = spark.range(0, 100_000, 1, 4).selectExpr("'hot' AS k", "timestamp_seconds(1704067200 + id % 600) AS timestamp")
    events.union(spark.sql("SELECT 'late' AS k, timestamp'2024-02-01' AS timestamp")).write.parquet(source)
    stream = spark.readStream.schema("k STRING, timestamp TIMESTAMP").parquet(source)
    query = windows.write_updates(windows.closed_sessions(stream, ["k"]), out, checkpoint, "append", once=True)
    sinks.run_to_end(query)
    plan = query._jsq.explainInternal(False)
    assert plan.index("Exchange") < plan.rindex("MergingSessions")  # printed from the top: one merge below the shuffle
    found = sinks.read_epochs(spark, out, "k STRING, started_at TIMESTAMP, last_active_at TIMESTAMP, event_count BIGINT")
    assert [tuple(r) for r in found.select("k", "event_count").collect()] == [("hot", 100_000)]
    assert found.select(F.max("last_active_at")).first()[0] == dt.datetime(2024, 1, 1, 0, 9, 59)
