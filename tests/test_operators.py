import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text, times
from tidegauge.functions.urls import extract_path
from tidegauge.operators import enrich, quality, requests, routing, sessions
from tidegauge.schemas import HTTP_STATUS
from workload import adapters as A

KEY = "a1B2" * 8


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize(
    "authorization,x_api_key,code,env",
    [
        (f"Bearer owk_test_{KEY}", None, None, "test"),
        (f"Bearer owk_live_{KEY}", "garbage", None, "live"),
        (None, f" owk_live_{KEY} ", None, "live"),
        ("Basic abc", f"owk_test_{KEY}", None, "test"),
        (None, None, "AUTH_001", None),
        ("Bearer ", f"owk_test_{KEY}", "AUTH_001", None),
        (None, "", "AUTH_001", None),
        ("Bearer owk_test_short1", None, "AUTH_002", None),
        (f"Bearer key_test_{KEY}", None, "AUTH_002", None),
        (f"Bearer owk_prod_{KEY}", None, "AUTH_002", None),
        (f"Bearer owk_test_{KEY[:31]}!", None, "AUTH_002", None),
    ],
)
def test_api_keys(spark, authorization, x_api_key, code, env):
    df = spark.createDataFrame([(authorization, x_api_key)], "authorization STRING, x_api_key STRING")
    row = requests.classify_api_keys(df).first()
    assert (row["key_code"], row["key_env"]) == (code, env)
    assert code is None or HTTP_STATUS[code] == 401


def test_user_agents(spark):
    agents = [
        *A.USER_AGENTS,
        "",
        "Mozilla/5.0 (Windows NT 10.0; WOW64) AppleWebKit/537.36 Chrome/109.0.1518.52 Safari/537.36 Edg/109.0.1518.78",
        "Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) Safari/604.1",
        "Mozilla/5.0 (Linux; Android 12; SM-A525F) AppleWebKit/537.36 Chrome/111.0.5563.116 Mobile Safari/537.36",
    ]
    rows = [(i, a, "unknown", "unknown", "unknown", "unknown") for i, a in enumerate(agents)]
    schema = "i INT, user_agent STRING, browser STRING, browser_version STRING, os STRING, device_type STRING"
    got = [tuple(r)[2:] for r in enrich.enrich_user_agent(spark.createDataFrame(rows, schema)).orderBy("i").collect()]
    assert got == [
        ("Chrome", "124.0.6367.91", "Mac OSX", "desktop"),
        ("Chrome", "109.0.5414.168", "Windows 10", "desktop"),
        ("Safari", "16.5", "iPhone", "mobile"),
        ("Firefox", "115.3", "Linux", "desktop"),
        ("Googlebot", "unknown", "unknown", "bot"),
        ("unknown", "unknown", "unknown", "unknown"),
        ("unknown", "unknown", "unknown", "unknown"),
        ("Edge", "109.0.1518.78", "Windows 10", "desktop"),
        ("Safari", "unknown", "iPhone", "mobile"),
        ("Chrome", "111.0.5563.116", "Android", "mobile"),
    ]
    kept = spark.createDataFrame([(0, agents[0], "x", "x", "x", "tablet")], schema)
    assert tuple(enrich.enrich_user_agent(kept).first())[2:] == ("Chrome", "124.0.6367.91", "Mac OSX", "tablet")


def test_paths_and_formats(spark):
    urls = ["https://example.com/foo/bar", "https://example.com", "invalid", "https://example.com/a?b#c"]
    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    assert [r[0] for r in df.select(extract_path(F.col("u"))).collect()] == ["/foo/bar", "/", "/", "/a"]
    sizes = {500: "500 B", 1024: "1.00 KB", 1048576: "1.00 MB", 1073741824: "1.00 GB", 1610612736: "1.50 GB"}
    df = spark.createDataFrame([(s,) for s in sizes], "s BIGINT")
    assert [r[0] for r in df.select(text.format_bytes(F.col("s"))).collect()] == list(sizes.values())
    cutoffs = [("2024-01-15", 3, "202310"), ("2024-03-15", 3, "202312"), ("2024-01-15", 1, "202312")]
    for day, keep, month in cutoffs:
        assert spark.range(1).select(times.cutoff_month(F.lit(day).cast("date"), keep)).first()[0] == month


def test_client_ip(spark):
    df = spark.createDataFrame([("1.2.3.4 , 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), (None, None)], "f STRING, r STRING")
    got = [r[0] for r in df.select(requests.client_ip(F.col("f"), F.col("r"))).collect()]
    assert got == ["1.2.3.4", "9.9.9.9", None]


def _activity(spark, seconds):
    return spark.createDataFrame([("p", "u", at(s)) for s in seconds], "project_id STRING, user STRING, timestamp TIMESTAMP")


def _brute_visits(seconds):
    visits = []
    for s in sorted(seconds):
        if visits and s - visits[-1][-1] <= 1800:
            visits[-1].append(s)
        else:
            visits.append([s])
    return [(at(v[0]), at(v[-1]), len(v)) for v in visits]


def test_visits_match_brute_force(spark):
    seconds = [0, 1800, 3601, 5401.000001, 9000, 10799, 10800, 12599.999999] + [20000 + (i * i * 37) % 90000 for i in range(300)]
    df = _activity(spark, seconds)
    expected = _brute_visits(seconds)
    by_gap = sessions.sessionize(df, ["project_id", "user"], F.lit("2024-01-01").cast("timestamp")).orderBy("visit")
    assert [(r["started_at"], r["last_active_at"], r["event_count"]) for r in by_gap.collect()] == expected
    windows = sessions.session_windows(df, ["project_id", "user"]).orderBy("started_at")
    assert [tuple(r)[2:] for r in windows.collect()] == expected


def test_sequence_of_a_hot_session(spark):
    """One session with a third of all rows; numbering is whole and no task sorts the session."""
    rows = spark.range(3000).selectExpr(
        "concat('e', lpad(id, 5, '0')) AS event_id", "'p' AS project_id",
        "if(id % 3 = 0, 'hot', concat('s', id)) AS session_id", "timestamp_seconds(1704067200 + id * 7) AS timestamp",
    )
    numbered = enrich.session_sequence(rows)
    hot = numbered.filter("session_id = 'hot'").orderBy("timestamp").collect()
    assert [r["sequence_number"] for r in hot] == list(range(1, 1001))
    assert numbered.filter("session_id <> 'hot'").agg(F.max("sequence_number")).first()[0] == 1


def test_geo_ranges_across_blocks(spark):
    base = 16777216
    ranges = spark.createDataFrame(
        [(base, base + 200000, "A", None, None, 1.0, 2.0), (base + 200001, base + 200001, "B", "r", "c", 3.0, 4.0)],
        "start BIGINT, end BIGINT, country STRING, region STRING, city STRING, lat DOUBLE, lng DOUBLE",
    )
    ips = ["1.0.0.0", "1.3.13.64", "1.3.13.65", "1.3.13.66", "300.1.1.1", "::1", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i INT, ip STRING")
    got = enrich.enrich_geo(df, ranges).orderBy("i").collect()
    assert [r["geo_country"] for r in got] == ["A", "A", "B", None, None, None, None]


def test_latency_histogram_bounds(spark):
    values = [0, 1, 2, 5, 6, 10, 25, 50, 100, 250, 500, 1000, 1001, 5000, 5001, 10000, 10001, 99999]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms BIGINT")
    got = {r["bound_ms"]: r["count"] for r in quality.latency_histogram(df).collect()}
    assert got == {1: 2, 5: 2, 10: 2, 25: 1, 50: 1, 100: 1, 250: 1, 500: 1, 1000: 1, 5000: 2, 10000: 4}
    empty = quality.latency_histogram(df.filter("latency_ms < 0")).collect()
    assert len(empty) == 11 and all((r["count"], r["mean"]) == (0, 0.0) for r in empty)


def test_tables_due_for_compaction(spark):
    files = spark.createDataFrame(
        [("a", f"f{i}", 10, 5) for i in range(4)] + [("b", f"g{i}", 10, 500) for i in range(9)],
        "table STRING, file STRING, rows BIGINT, bytes BIGINT",
    )
    stats = quality.file_stats(files, small_bytes=100)
    assert [tuple(r) for r in stats.collect()] == [("b", 9, 90, 4500, 0), ("a", 4, 40, 20, 4)]
    assert [r["table"] for r in quality.high_file_count(stats, 3).collect()] == ["a"]


def test_alert_rules_are_strict(spark):
    rows = [(at(0), 100, 100, 0), (at(60), 1000, 100, 0), (at(120), 1000, 101, 0), (at(180), 0, 0, 1)]
    schema = "timestamp TIMESTAMP, events_received BIGINT, events_failed_validation BIGINT, backpressure_active INT"
    found = quality.system_alerts(spark.createDataFrame(rows, schema)).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["key"]) for r in found] == [(at(120), "error_rate"), (at(180), "backpressure")]
    assert found[0]["message"] == "High validation error rate: 10.10%"


def test_cooldown(spark):
    rows = [("k", "a", at(60 * m)) for m in (0, 5, 11, 30)] + [("k", "b", at(0))]
    found = quality.alert_cooldown(spark.createDataFrame(rows, "kind STRING, key STRING, timestamp TIMESTAMP"), 6)
    assert sorted((r["key"], r["timestamp"]) for r in found.collect()) == [("a", at(0)), ("a", at(1800)), ("b", at(0))]


def test_rows_keep_key_order_in_a_partition(spark):
    rows = spark.range(100).selectExpr(
        "concat('e', id) AS event_id", "concat('p', id % 3) AS project_id", "concat('s', id % 7) AS session_id",
        "timestamp_seconds(1704067200 - id) AS timestamp",
    )
    placed = routing.ordered_by_key(rows, "session", 4).select("key", F.spark_partition_id().alias("p"))
    assert placed.distinct().count() == 7
