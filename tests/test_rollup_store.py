"""Exact distinct counts from stored bitmaps, and percentiles from merged sketches, against plain counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import distinct, quality
from tidegauge.plans import rollup_store

COLUMNS = "project_id STRING, session_id STRING, user_id STRING, event_type STRING, timestamp TIMESTAMP"


def _events(days, seed=1, ids=60):
    rnd = random.Random(seed)
    day = lambda: dt.datetime(2024, 1, 28) + dt.timedelta(days=rnd.choice(days), hours=rnd.randrange(24))
    pick = lambda kind, n: rnd.choice([None, *(f"{kind}{k}" for k in range(n))])
    return [(rnd.choice("ab"), pick("s", ids) or "s", pick("u", 9), rnd.choice(["click", "view"]), day()) for _ in range(500)]


def _plain(rows, period):
    groups = {}
    for project, session, user, kind, time in rows:
        groups.setdefault((project, period(time), kind), []).append((session, user))
    return sorted(
        (*key, len(own), len({s for s, _ in own}), len({u for _, u in own if u is not None})) for key, own in groups.items()
    )


def test_days_months_and_users(spark, tmp_path):
    root, early, late = str(tmp_path), _events([0, 1, 2]), _events([3, 4, 5], 2, 90)
    frame = lambda rows: spark.createDataFrame(rows, COLUMNS).repartition(3)
    for rows in (early, late, early):  # a day range again gives the same tables
        rollup_store.add_days(frame(rows), root)
    every = early + late
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(rollup_store.daily(spark, root)) == _plain(every, lambda t: t.date())
    assert got(rollup_store.monthly(spark, root)) == _plain(every, lambda t: t.strftime("%Y%m"))
    users = {}
    for project, _, user, _, time in every:
        users.setdefault((project, time.strftime("%Y%m")), set()).add(user)
    assert got(rollup_store.active_users(spark, root)) == sorted((*k, len(v - {None})) for k, v in users.items())


def test_codes_are_dense_and_stay(spark, tmp_path):
    root = str(tmp_path)
    rollup_store.add_days(spark.createDataFrame(_events([0]), COLUMNS), root)
    path = f"{root}/codes_sessions"
    first = {(r["project_id"], r["id"]): r["code"] for r in spark.read.parquet(path).collect()}
    rollup_store.add_days(spark.createDataFrame(_events([1], 3, 120), COLUMNS), root)
    second = {(r["project_id"], r["id"]): r["code"] for r in spark.read.parquet(path).collect()}
    assert len(second) > len(first) and first.items() <= second.items()
    for project in "ab":
        assert sorted(c for (p, _), c in second.items() if p == project) == list(range(sum(p == project for p, _ in second)))


def test_ids_beyond_one_bitmap(spark):
    ids = spark.range(100_000).selectExpr("'p' AS project_id", "string(id) AS id", "id AS code")
    events = ids.selectExpr("project_id", "id AS session_id", "'click' AS event_type", "timestamp'2024-01-01 12:00:00' AS timestamp")
    bitmaps = distinct.daily_bitmaps(events.union(events.limit(10)), "session_id", ids)
    assert bitmaps.count() == 4  # 32768 ids to a bucket
    assert distinct.distinct_counts(bitmaps, ["project_id"], "n").first()["n"] == 100_000


def test_no_expand(spark, tmp_path):
    rollup_store.add_days(spark.createDataFrame(_events([0]), COLUMNS), str(tmp_path))
    for found in (rollup_store.daily(spark, str(tmp_path)), rollup_store.monthly(spark, str(tmp_path))):
        assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_empty_store(spark, tmp_path):
    assert rollup_store.daily(spark, str(tmp_path)).count() == 0
    rollup_store.add_days(spark.createDataFrame([], COLUMNS), str(tmp_path))
    assert rollup_store.monthly(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [1, 10, 200_000])
def test_merged_sketches_keep_their_rank_error(spark, n):
    """Heavy-tailed latencies over 24 hours: minutes, merged to days, merged to a year."""
    rows = spark.range(n).selectExpr(
        "'p' AS project_id", "timestamp_seconds(1704067200 + id % 86400) AS received_at",
        "CAST(exp(12 * (xxhash64(id) % 1000000 + 1000000) / 2000000) AS BIGINT) AS latency_ms",
    )
    rows = rows.unionByName(rows.limit(5).withColumn("latency_ms", F.lit(None).cast("bigint")))
    minutes = quality.latency_sketches(rows, ["project_id"])
    merged = quality.merge_latency_sketches(quality.merge_latency_sketches(minutes, ["project_id"]), ["project_id"], "year")
    found = quality.sketch_summary(merged, ["project_id"]).first()
    values = sorted(r[0] for r in rows.where("latency_ms IS NOT NULL").select("latency_ms").collect())
    assert (found["count"], found["min_ms"], found["max_ms"]) == (n, values[0], values[-1])
    assert found["mean_ms"] == pytest.approx(sum(values) / n)
    for name, rank in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        below, upto = sum(v < found[name] for v in values), sum(v <= found[name] for v in values)
        assert below - max(1, 0.01 * n) <= rank * n <= upto + max(1, 0.01 * n)
