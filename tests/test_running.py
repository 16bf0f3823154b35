"""The prefix scan against a plain loop, over keys that spread over many partitions."""

import datetime as dt
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.running import prefix_scan
from tidegauge.operators import enrich, quality


@pytest.fixture
def many_parts(spark):
    """Small ranges that stay apart."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _plain(rows, combine):
    held, out = {}, []
    for k, j, t, v in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[:3])):
        seen = held.get((k, j))
        if v is not None:
            seen = v if seen is None else (seen + v if combine == "sum" else max(seen, v))
        held[k, j] = seen
        out.append((k, j, t, v, seen))
    return sorted(out, key=repr)


@pytest.mark.parametrize("combine, kind", [("sum", "LONG"), ("max", "LONG"), ("max", "DOUBLE")])
def test_prefix_scan_against_a_plain_loop(spark, many_parts, combine, kind):
    rnd = random.Random(2)
    number = (lambda: rnd.randrange(-9, 10)) if kind == "LONG" else (lambda: rnd.randrange(-9, 10) / 2)
    keys = ["hot"] * 8 + ["a", "b", None, ""]
    rows = [(rnd.choice(keys), rnd.choice([1, 1, None]), t or None, rnd.choice([number(), number(), None])) for t in range(3000)]
    frame = spark.createDataFrame(rows, f"k STRING, j INT, t INT, v {kind}").repartition(5)
    found = prefix_scan(frame, ["k", "j"], ["t"], {"total": F.col("v")}, combine)
    assert sorted(map(tuple, found.collect()), key=repr) == _plain(rows, combine)
    assert prefix_scan(frame.limit(0), ["k", "j"], ["t"], {"total": F.col("v")}, combine).count() == 0


def test_prefix_scan_without_keys(spark, many_parts):
    frame = spark.range(1000).withColumn("n", F.col("id") % 7)
    found = prefix_scan(frame, [], ["id"], {"a": F.col("n"), "b": F.lit(1)}, "sum").orderBy("id").collect()
    totals, seen = [], 0
    for k in range(1000):
        seen += k % 7
        totals.append((k, k % 7, seen, k + 1))
    assert list(map(tuple, found)) == totals


def test_one_scan_and_no_join_of_the_rows(spark, tmp_path):
    events = spark.range(50).selectExpr("'p' AS project_id", "'s' AS session_id", "string(id) AS event_id", "timestamp_seconds(id) AS timestamp")
    events.write.parquet(str(tmp_path / "events"))
    found = enrich.session_sequence(spark.read.parquet(str(tmp_path / "events")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan  # the source is read, ranged and sorted once
    assert sorted(r["sequence_number"] for r in found.collect()) == list(range(1, 51))


def test_a_session_of_a_million_events_in_one_hour(spark, many_parts):
    """No task holds much more than its share of the hot session."""
    n = 1_000_000
    events = spark.range(0, n, 1, 8).selectExpr(
        "'p' AS project_id", "'s' AS session_id", "string(id) AS event_id",
        "timestamp_micros(1704067200000000 + (id * 7919 % 3600000) * 1000) AS timestamp",
    )
    found = enrich.session_sequence(events)
    at = F.max(F.struct("timestamp", "event_id"))
    row = found.agg(
        F.count_distinct("sequence_number").alias("n"), F.min("sequence_number").alias("low"), F.max("sequence_number").alias("high"),
        F.max_by("sequence_number", F.struct("timestamp", "event_id")).alias("last"), at.alias("at"),
    ).first()
    assert (row["n"], row["low"], row["high"], row["last"]) == (n, 1, n, n)
    sizes = [pq.read_metadata(file.removeprefix("file://")).num_rows for file in set(found.inputFiles())]
    assert len(sizes) >= 10 and max(sizes) < n / 4


def test_cumulative_counters_keep_their_columns(spark):
    from tidegauge import schemas as S

    rows = [(dt.datetime(2024, 1, 1, 0, m), *[m] * len(S.COUNTERS)) for m in range(4)]
    frame = spark.createDataFrame(rows, "timestamp TIMESTAMP, " + ", ".join(f"{c} LONG" for c in S.COUNTERS))
    found = quality.cumulative_metrics(frame).orderBy("timestamp").collect()
    assert [r[S.COUNTERS[0]] for r in found] == [0, 1, 3, 6]
