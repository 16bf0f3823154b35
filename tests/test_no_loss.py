"""No input loses rows, stops a job or destroys earlier output."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import NOW_MS, sdk_event
from tidegauge.functions.running import prefix_scan
from tidegauge.functions.urls import extract_path
from tidegauge.operators import dedupe, legacy, requests
from tidegauge.plans import ingest, maintenance
from tidegauge.sources import broker
from workload import adapters as A, dimensions as D

URLS = {
    "https://example.com/shop/cart?f=a|b": "/shop/cart",
    "https://example.com/a b": "/a%20b",
    "https://example.com/{id}/x": "/%7Bid%7D/x",
    "https://example.com/100%": "/100%",
    "https://example.com?q={x}": "/",
    "https://example.com/p?q={x}": "/p",
    "https://example.com/a|b": "/a|b",
    "https://example.com": "/",
    "https://example.com/": "/",
    "https://example.com#top": "/",
    "https://example.com/a#b?c": "/a",
    "https://example.com/a/./b": "/a/b",
    "https://example.com/a/../b": "/b",
    "https://example.com/a/b/..": "/a/",
    "https://example.com/../..": "/",
    "https://example.com/a/.": "/a/",
    "https://example.com/a//b/": "/a//b/",
    "https://example.com/%2e%2E/x": "/x",
    "https://example.com/é": "/%C3%A9",
    "https://example.com\\a\\b": "/a/b",
    "  https://example.com/x  ": "/x",
    "https://user:pw@example.com:8080/y": "/y",
    'https://example.com/"q"<>`': "/%22q%22%3C%3E%60",
    "not a url": "/",
    "/relative/path": "/",
    "https://exa mple.com/x": "/",
    "": "/",
}


def test_url_paths(spark):
    rows = spark.createDataFrame(list(URLS.items()), "url STRING, want STRING")
    found = rows.select("url", "want", extract_path(F.col("url")).alias("got")).where("got <> want OR got IS NULL")
    assert [tuple(r) for r in found.collect()] == []


@pytest.mark.parametrize("time", [-(2**63), 2**63 - 1, 0])
def test_extreme_event_time_is_a_rejection(spark, raw, time):
    events = ingest.quarantined(raw([sdk_event(timestamp=time), sdk_event()]))
    assert [("24h" in r["error"]) or ("5s" in r["error"]) for r in events.collect()] == [True]


def test_extreme_record_time_is_malformed(spark):
    def record(time):
        names = [n for n, _ in broker._FIELDS]
        return json.dumps({n: time if n == "timestamp" else "x" for n in names})

    rows = spark.createDataFrame([(record(t),) for t in (-(2**63), 2**63 - 1, NOW_MS)], "value STRING")
    found = broker.decode_records(rows).select("malformed").collect()
    assert [r["malformed"] for r in found] == [True, True, False]


def test_running_totals_keep_null_keys_and_times(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00', 1), ('a', NULL, 2), (NULL, timestamp'2024-01-01 00:10:00', 3),"
        " (NULL, NULL, 4), ('a', timestamp'2024-01-01 05:00:00', 5) AS t(k, at, n)"
    )
    found = prefix_scan(rows, ["k"], ["at", "n"], {"total": F.col("n")}, "sum")
    assert sorted((r["n"], r["total"]) for r in found.collect()) == [(1, 3), (2, 2), (3, 7), (4, 4), (5, 8)]


def test_legacy_refuses_trailing_text(spark):
    good = '{"type": "pageview"}'
    rows = spark.createDataFrame([(good + " junk",), (good + good,), (good,)], "value STRING")
    rows = rows.withColumn("arrived_at", F.lit("2024-01-01 12:00:00").cast("timestamp"))
    errors = [r["decode_error"] for r in legacy.decode(rows).select("decode_error").collect()]
    assert errors[:2] == ["not JSON", "not JSON"] and errors[2] != "not JSON"


def test_white_space_around_keys(spark):
    row = spark.range(1).select(
        requests.api_key(F.lit("Bearer \t key\r\n"), F.lit(None)).alias("key"),
        requests.client_ip(F.lit("\t1.2.3.4\n, 5.6.7.8"), F.lit(None)).alias("ip"),
    ).first()
    assert tuple(row) == ("key", "1.2.3.4")


def test_dedupe_keeps_the_first_delivery(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('p', 'e', timestamp'2024-01-02', 'late'), ('p', 'e', timestamp'2024-01-01', 'early')"
        " AS t(project_id, event_id, created_at, url)"
    )
    assert [r["url"] for r in dedupe.dedupe_events(rows).collect()] == ["early"]


def test_second_export_and_compression_keep_the_first(spark, tmp_path):
    events = A.flat_events(spark, "/root/testdata/sf0.001")
    policies = D.policies(spark, "/root/testdata/sf0.001") if hasattr(D, "policies") else None
    if policies is None:
        pytest.skip("no policy table")
    first, later = F.lit("2024-06-01").cast("timestamp"), A.as_of()
    for job, path in ((maintenance.export_cold, "cold"),):
        job(events, policies, first, str(tmp_path / path))
        before = spark.read.parquet(str(tmp_path / path)).count()
        job(events, policies, later, str(tmp_path / path))
        job(events, policies, later, str(tmp_path / path))
        runs = spark.read.parquet(str(tmp_path / path)).groupBy("run").count().collect()
        assert len(runs) == 2 - (before == 0)
        assert sum(r["count"] for r in runs) == before + maintenance.cold_rows(events, policies, later).count()


def test_plain_and_odd_urls_give_the_same_path(spark):
    """The short way for plain URLs answers as the long one does (an encoded letter forces that)."""
    cases = {
        "https://example.com/a/b": "/a/b", "https://example.com/a/b?q=/../x": "/a/b", "https://example.com/a/../b": "/b",
        "https://example.com/..a/.b/c.": "/..a/.b/c.", "https://example.com/a/.": "/a/", "https://example.com/a/..#x": "/",
        "https://example.com:8080/a//b/": "/a//b/", "http://h/a\n": "/a", "http://h/a?x=\ny": "/a", "http://h": "/",
        "http://h?q": "/", "/a/b": "/", "http:///a": "/", "http://u:p@h/a": "/a", "http://h/a?{}|": "/a",
        "http://h/./a": "/a", "http://h/a/.?q": "/a/", "http://h/" + "a/" * 5000: "/" + "a/" * 5000,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url STRING")
    got = {r["url"]: r["path"] for r in rows.select("url", extract_path(F.col("url")).alias("path")).collect()}
    assert got == cases
