"""Micro-batches reach the events table exactly once, whatever fails on the way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge import schemas as S
from tidegauge.plans import loading
from tidegauge.sources import broker, tables
from tidegauge.streaming import ingest, sinks


@pytest.fixture
def database(spark, tmp_path):
    name = tables.fresh_database(spark, "loading_tests", str(tmp_path / "database"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def events(spark, *ids, project="p"):
    """Events of two months, by the parity of their ids."""
    rows = [(f"e{i}", project, dt.datetime(2024, 1 + i % 2, 5, 12), f"d{n}") for n, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "event_id STRING, project_id STRING, timestamp TIMESTAMP, data STRING")
    frame = tables.conform(frame, "events", {"created_at": F.col("timestamp")})
    return frame.withColumn("month", F.date_format("timestamp", "yyyyMM"))


def land(spark, path, epoch, *ids):
    sinks.write_epoch(events(spark, *ids), path, epoch, ["month"])


def stored(spark, database):
    return sorted(r["event_id"] for r in spark.table(f"{database}.events").collect())


def ledger(spark, database):
    rows = spark.table(f"{database}.{loading.LEDGER}").select("epoch", "landed_rows").collect()
    return sorted(tuple(r) for r in rows)


def test_epochs_are_loaded_once(spark, database, tmp_path):
    path = str(tmp_path / "landed")
    land(spark, path, 0, 1, 2, 3)
    land(spark, path, 1)
    assert loading.load_epochs(spark, path, database) == [0, 1]
    land(spark, path, 1)  # the micro-batch is replayed
    land(spark, path, 2, 4)
    assert loading.load_epochs(spark, path, database) == [2]
    assert loading.load_epochs(spark, path, database) == []
    assert stored(spark, database) == ["e1", "e2", "e3", "e4"]
    assert ledger(spark, database) == [(0, 3), (1, 0), (2, 1)]
    assert loading.landed_epochs(spark, path) == {}
    assert tables.partition_months(spark, database, "events") == ["202401", "202402"]


def test_streams_have_epochs_of_their_own(spark, database, tmp_path):
    for stream in ("a", "b"):
        path = str(tmp_path / stream)
        land(spark, path, 0, 1)
        assert loading.load_epochs(spark, path, database, stream) == [0]
    assert stored(spark, database) == ["e1", "e1"]


def test_deduplication_is_a_choice(spark, database, tmp_path):
    path = str(tmp_path / "landed")
    land(spark, path, 0, 1, 1, 2)
    loading.load_epochs(spark, path, database)
    assert stored(spark, database) == ["e1", "e1", "e2"]
    land(spark, path, 1, 7, 7, 8)
    loading.load_epochs(spark, path, database, dedupe=True)
    assert stored(spark, database) == ["e1", "e1", "e2", "e7", "e8"]


CRASHES = {
    "before the stage is complete": ("tables.partition_count", None),
    "before the first file is published": ("loading.publish", 0),
    "between two files": ("tables.rename", 1),
    "between publishing and the ledger": ("loading.commit", 0),
    "between the ledger and the clean-up": ("tables.remove_folder", 0),
    "in the middle of the clean-up": ("tables.remove_folder", 1),
}


@pytest.mark.parametrize("crash", CRASHES)
def test_a_crash_loses_and_repeats_nothing(spark, database, tmp_path, monkeypatch, crash):
    path = str(tmp_path / "landed")
    land(spark, path, 0, 1, 2, 3, 4)
    land(spark, path, 1, 5, 6)
    name, after = CRASHES[crash]
    if after is None:
        # A stage that was being written when the driver went.
        location = tables.location(spark, database, "events")
        events(spark, 1).write.parquet(f"{location}/{loading._STAGES}/events-dead/rows")
        (tmp_path / "database" / "events" / loading._STAGES / "events-dead" / "rows" / "_SUCCESS").unlink()
    else:
        module, function = name.split(".")
        target = {"loading": loading, "tables": tables}[module]
        real, calls = getattr(target, function), []

        def failing(*args):
            calls.append(args)
            if len(calls) == after + 1:
                raise OSError("gone")
            return real(*args)

        monkeypatch.setattr(target, function, failing)
        with pytest.raises(OSError):
            loading.load_epochs(spark, path, database)
        monkeypatch.setattr(target, function, real)
    land(spark, path, 2, 7)
    assert 2 in loading.load_epochs(spark, path, database)
    assert stored(spark, database) == [f"e{k}" for k in range(1, 8)]
    assert ledger(spark, database) == [(0, 4), (1, 2), (2, 1)]
    assert loading.load_epochs(spark, path, database) == []
    location = tables.location(spark, database, "events")
    assert tables.folders(spark, f"{location}/{loading._STAGES}", "*") == []


def test_a_load_does_not_read_the_months(spark, database, tmp_path):
    """A data file that nothing can read lies in the month; loading into the month works all the same."""
    path = str(tmp_path / "landed")
    land(spark, path, 0, 1)
    loading.load_epochs(spark, path, database)
    broken = tmp_path / "database" / "events" / "month=202402" / "broken.parquet"
    broken.write_bytes(b"not parquet")
    land(spark, path, 1, 3, 5)
    assert loading.load_epochs(spark, path, database, dedupe=True) == [1]
    broken.unlink()
    spark.catalog.refreshTable(f"{database}.events")
    assert stored(spark, database) == ["e1", "e3", "e5"]


# --- retries ------------------------------------------------------------------------------


def _record(k):
    values = {"event_id": f"e{k}", "timestamp": 1704110400000, "type": "click"}
    names = [p.split()[0] for p in S.BROKER_RECORD.split(",")]
    fields = {n: values.get(n, "x") for n in names}
    return "{" + ",".join(f'"{n}":{v}' if n == "timestamp" else f'"{n}":"{v}"' for n, v in fields.items()) + "}"


def _failing(monkeypatch, times):
    real, calls = ingest.write_epoch, []

    def write(df, path, epoch, partition_by=None):
        if path.endswith("events"):
            calls.append(epoch)
            if len(calls) <= times:
                real(df.limit(1), path, epoch, partition_by)  # a part is written before the fault
                raise OSError("sink away")
        real(df, path, epoch, partition_by)

    monkeypatch.setattr(ingest, "write_epoch", write)
    return calls


@pytest.mark.parametrize("faults, on_failure", [(0, "replay"), (2, "replay"), (3, "quarantine"), (4, "quarantine")])
def test_a_passing_fault_is_retried(spark, tmp_path, monkeypatch, faults, on_failure):
    source, good, bad, checkpoint = (str(tmp_path / d) for d in ("in", "events", "bad", "checkpoint"))
    spark.createDataFrame([(_record(k),) for k in range(5)] + [("{}",)], "value STRING").write.parquet(source)
    stream = spark.readStream.schema("value STRING").parquet(source)
    calls = _failing(monkeypatch, faults)
    waits = []
    monkeypatch.setattr(sinks, "sleep", waits.append)
    sinks.run_to_end(ingest.ingest_stream(stream, good, bad, checkpoint, on_failure=on_failure, once=True))
    rows = sorted(map(tuple, spark.read.parquet(bad).select("reason", "attempts").collect()))
    assert waits == pytest.approx([0.1, 0.2, 0.3][:faults])
    if faults == 4:
        assert len(calls) == 4 and rows == [("write failed", 4)] * 6
        assert loading.landed_epochs(spark, bad) and spark.read.parquet(bad).count() == 6
    else:
        assert len(calls) == faults + 1 and rows == [("malformed", 0)]
        found = sinks.read_epochs(spark, good, "event_id STRING, month STRING").collect()
        assert sorted(r["event_id"] for r in found) == [f"e{k}" for k in range(5)]


def test_a_quarantined_batch_leaves_no_part_behind(spark, tmp_path, monkeypatch):
    """What a failed last attempt wrote must not be loaded beside the quarantined records."""
    source, good, bad, checkpoint = (str(tmp_path / d) for d in ("in", "events", "bad", "checkpoint"))
    spark.createDataFrame([(_record(k),) for k in range(5)], "value STRING").write.parquet(source)
    _failing(monkeypatch, 9)
    monkeypatch.setattr(sinks, "sleep", lambda _: None)
    stream = spark.readStream.schema("value STRING").parquet(source)
    sinks.run_to_end(ingest.ingest_stream(stream, good, bad, checkpoint, on_failure="quarantine", once=True))
    assert loading.landed_epochs(spark, good) == {}
    assert spark.read.parquet(bad).count() == 5


def test_flush_options():
    assert broker.flush_options() == {}
    assert broker.flush_options(10_000, 5000, "1s") == {
        "maxOffsetsPerTrigger": "10000", "minOffsetsPerTrigger": "5000", "maxTriggerDelay": "1s"
    }
    with pytest.raises(ValueError):
        broker.flush_options(at_least=5000)
