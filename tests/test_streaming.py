import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import sdk_event
from tidegauge.plans import ingest as batch
from tidegauge.streaming import ingest, sessions, sinks, windows
from workload import streams

ROW = "event_id STRING, project_id STRING, session_id STRING, event_type STRING, timestamp TIMESTAMP"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def rows(spark, *events):
    data = [(f"e{i}", "p", s, kind, at(m)) for i, (s, kind, m) in enumerate(events)]
    return spark.createDataFrame(data, ROW)


def test_stateful_sessions_over_several_runs(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))

    def run(*events):
        rows(spark, *events).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        closed = sessions.stateful_sessions(stream, delay="10 minutes")
        sinks.run_to_end(windows.write_updates(closed, out, checkpoint, "append", once=True))

    run(("a", "click", 0), ("b", "click", 5), ("a", "click", 20), ("c", "click", 0), ("c", "session_end", 10))
    run(("a", "click", 45), ("d", "click", 300))
    schema = (
        "project_id STRING, session_id STRING, started_at TIMESTAMP, last_active_at TIMESTAMP, "
        "event_count BIGINT, duration_ms BIGINT, end_reason STRING"
    )
    got = sinks.read_epochs(spark, out, schema).drop("epoch", "project_id").collect()
    assert sorted(tuple(r) for r in got) == [
        ("a", at(0), at(45), 3, 45 * 60000, "timeout"),
        ("b", at(5), at(5), 1, 0, "timeout"),
        ("c", at(0), at(10), 2, 600000, "ended"),
    ]


@pytest.mark.parametrize("cuts", [[], [2], [1, 2], [2, 3]])
def test_sessions_do_not_depend_on_micro_batches(spark, tmp_path, cuts):
    """An event after the end opens a new session, whichever micro-batch brings it."""
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    events = [("a", "click", 0), ("a", "click", 4), ("a", "session_end", 2), ("b", "click", 1), ("z", "click", 300)]
    for start, end in zip([0, *cuts], [*cuts, len(events)]):
        rows(spark, *events[start:end]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        closed = sessions.stateful_sessions(stream, delay="10 minutes")
        sinks.run_to_end(windows.write_updates(closed, out, checkpoint, "append", once=True))
    schema = "session_id STRING, started_at TIMESTAMP, event_count BIGINT, end_reason STRING"
    got = sinks.read_epochs(spark, out, schema).drop("epoch").collect()
    assert sorted(tuple(r) for r in got) == [
        ("a", at(0), 2, "ended"), ("a", at(4), 1, "timeout"), ("b", at(1), 1, "timeout")
    ]


def _plain_sessions(events, until, gap=30 * 60_000):
    """(session, milliseconds, kind) one by one: the visits closed at ``until``."""
    found, by_session = [], {}
    for session, ms, kind in events:
        by_session.setdefault(session, []).append((ms, kind == "session_end"))
    for session, times in by_session.items():
        visits = []
        ends = {ms // 1000 for ms, ended in times if ended}
        for ms, _ in sorted(times):
            last = visits[-1][-1] if visits else None
            if last is not None and ms - last <= gap and not (last // 1000 in ends and last // 1000 != ms // 1000):
                visits[-1].append(ms)
            else:
                visits.append([ms])
        for visit in visits:
            ended = visit[-1] // 1000 in ends
            if ((visit[-1] // 1000 + 1) * 1000 if ended else visit[-1] + gap + 1) <= until:
                found.append((session, visit[0], visit[-1], len(visit), "ended" if ended else "timeout"))
    return sorted(found, key=repr)


def _stream_sessions(spark, tmp_path, parts, **options):
    """Closed sessions of the parts, one run each, as plain tuples; and the last progress of every run."""
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    progress = []
    for part in parts:
        data = spark.createDataFrame(part, "session_id STRING, ms BIGINT, event_type STRING")
        stamped = data.select(F.lit("p").alias("project_id"), "session_id", "event_type", F.timestamp_millis("ms").alias("timestamp"))
        stamped.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(stamped.schema).parquet(source)
        closed = sessions.stateful_sessions(stream, delay="10 minutes", **options)
        query = windows.write_updates(closed, out, checkpoint, "append", once=True)
        sinks.run_to_end(query)
        progress += query.recentProgress
    schema = "session_id STRING, started_at TIMESTAMP, last_active_at TIMESTAMP, event_count BIGINT, end_reason STRING"
    got = sinks.read_epochs(spark, out, schema).withColumns({c: F.unix_millis(c) for c in ("started_at", "last_active_at")})
    return sorted(map(tuple, got.drop("epoch").collect()), key=repr), progress


def test_many_sessions_share_few_state_calls(spark, tmp_path):
    """3000 sessions of one event: the state function is called by bucket, not by session."""
    events = [(f"s{i}", 1_704_067_200_000 + i, "click") for i in range(3000)] + [("z", 1_704_090_000_000, "click")]
    got, progress = _stream_sessions(spark, tmp_path, [events])
    assert got == _plain_sessions(events, 1_704_090_000_000 - 600_000) and len(got) == 3000
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in progress) <= 1024


@pytest.mark.parametrize("buckets", [1, 3])
def test_sessions_of_a_bucket_against_a_plain_loop(spark, tmp_path, buckets):
    """Several runs, hot and null sessions, ends within a second; nothing is late."""
    rnd = random.Random(buckets)
    start, span, parts = 1_704_067_200_000, 4 * 3600_000, []
    for k in range(3):
        names = [*(f"s{i}" for i in range(40)), None] + ["hot"] * 20
        kinds = ["click"] * 5 + ["session_end"]
        parts.append([(rnd.choice(names), start + k * span + rnd.randrange(span), rnd.choice(kinds)) for _ in range(700)])
        parts[-1] += [("hot", start + (k + 1) * span - 1 - i % 3, rnd.choice([None, "click"])) for i in range(50)]
    parts.append([("z", start + 3 * span + 900_000, "click")])
    got, _ = _stream_sessions(spark, tmp_path, parts, buckets=buckets)
    assert got == _plain_sessions([e for part in parts for e in part], start + 3 * span + 300_000)


def test_entries_are_merged_as_they_stream_in(monkeypatch):
    monkeypatch.setattr(sessions, "_MERGE_ROWS", 3)
    rows = [("p", f"s{i % 4}", i // 8, i, i, 1, i % 5 == 0) for i in range(50)]
    frame = pd.DataFrame(rows, columns=["project_id", "session_id", *sessions._FIELDS])
    parts = [frame.iloc[k : k + 2] for k in range(0, 50, 2)]
    whole = sessions._merged(frame)
    for held in (None, sessions._unpacked(sessions._packed(sessions._merged(parts.pop(0))))):
        folded = sessions._fold(held, parts if held is not None else [frame])
        assert sorted(map(tuple, folded.values)) == sorted(map(tuple, whole.values))


def test_duplicates_are_dropped_across_runs(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    for _ in range(2):
        rows(spark, ("a", "click", 0), ("a", "click", 1)).write.mode("append").parquet(source)
        unique = ingest.dedupe_stream(spark.readStream.schema(ROW).parquet(source))
        sinks.run_to_end(windows.write_updates(unique, out, checkpoint, "append", once=True))
    assert sinks.read_epochs(spark, out, ROW).count() == 2


def test_bodies_stream_like_a_batch(spark, raw, tmp_path):
    bodies = raw([sdk_event(), sdk_event(id="")], "not json", sdk_event(id="e-2"))
    bodies.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(bodies.schema).parquet(str(tmp_path / "in"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    sinks.run_to_end(ingest.validate_stream(stream, good, bad, str(tmp_path / "checkpoint"), once=True))
    stored = spark.read.parquet(good)
    expected = batch.accepted_events(bodies, with_user_agent=True)
    assert sorted(map(tuple, stored.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    assert spark.read.parquet(bad).count() == batch.quarantined(bodies).count() == 2


def test_replay_overwrites_its_own_epoch(spark, tmp_path):
    for _ in range(2):
        sinks.write_epoch(rows(spark, ("a", "click", 0)), str(tmp_path), 7)
    assert sinks.read_epochs(spark, str(tmp_path), ROW).count() == 1


@pytest.mark.parametrize("mode", ["replay", "quarantine"])
def test_failed_write(spark, tmp_path, monkeypatch, mode):
    frame = spark.createDataFrame([("{}",)], "value STRING")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value STRING").parquet(str(tmp_path / "in"))
    real = ingest.write_epoch

    def failing(df, path, epoch, partition_by=None):
        if path.endswith("events"):
            raise OSError("disk")
        real(df, path, epoch, partition_by)

    monkeypatch.setattr(ingest, "write_epoch", failing)
    paths = [str(tmp_path / d) for d in ("events", "bad", "checkpoint")]
    query = ingest.ingest_stream(stream, *paths, on_failure=mode, once=True)
    if mode == "replay":
        with pytest.raises(Exception):
            sinks.run_to_end(query)
    else:
        sinks.run_to_end(query)
        assert spark.read.parquet(paths[1]).first()["reason"] == "write failed"


def test_hourly_stream_equals_batch(spark):
    from workload.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    a = QUERIES["stream_hourly_rollup"](spark, sf)
    b = QUERIES["hourly_rollup"](spark, sf).select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert streams.EVENTS
