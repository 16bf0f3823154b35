import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge import schemas as S
from tidegauge.functions.times import between
from tidegauge.operators import legacy, projections, quality, reads, routing
from tidegauge.plans import loading, maintenance
from tidegauge.sources import tables
from tidegauge.streaming import ingest, sinks
from workload import adapters as A, dimensions as D
from workload.legacy_records import legacy_records

SF = "/root/testdata/sf0.001"


@pytest.fixture
def database(spark):
    name = f"db_{dt.datetime.now().strftime('%H%M%S%f')}"
    tables.create_tables(spark, name)
    tables.create_tables(spark, name)  # creating again changes nothing
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_retention_and_deletion(spark, database):
    events = A.spread_events(spark, SF)
    tables.append(events, database, "events")
    stored = spark.table(f"{database}.events")
    assert stored.count() == events.count()
    rewritten = maintenance.delete_project(spark, database, "proj-3")
    assert rewritten == tables.partition_months(spark, database, "events")
    assert spark.table(f"{database}.events").count() == events.filter("project_id <> 'proj-3'").count()
    assert maintenance.delete_project(spark, database, "no such project") == []
    dropped = maintenance.run_retention(spark, database, "2024-01-31")
    assert set(dropped) == set(S.TABLES)
    assert len(dropped["events"]) == 8
    assert tables.partition_months(spark, database, "events") == ["202310", "202311", "202312", "202401"]
    tables.truncate(spark, database, "events")
    assert spark.table(f"{database}.events").count() == 0


def test_replaced_partitions_leave_the_others(spark, database):
    events = A.spread_events(spark, SF)
    tables.append(events, database, "events")
    january = events.filter(F.date_format("timestamp", "yyyyMM") == "202401").filter("event_type = 'click'")
    before = spark.table(f"{database}.events").filter("month <> '202401'").count()
    for _ in range(2):
        tables.replace_partitions(january, database, "events")
    assert spark.table(f"{database}.events").filter("month = '202401'").count() == january.count()
    assert spark.table(f"{database}.events").filter("month <> '202401'").count() == before


def test_deletion_rewrites_only_the_months_concerned(spark, database):
    events = A.spread_events(spark, SF)
    tables.append(events, database, "events")
    doomed = (F.col("project_id") == "proj-3") & (F.date_format("timestamp", "yyyyMM") == "202312")
    assert tables.delete_where(spark, database, "events", doomed) == ["202312"]
    assert spark.table(f"{database}.events").count() == events.filter(~doomed).count()
    whole_month = F.date_format("timestamp", "yyyyMM") == "202311"
    assert tables.delete_where(spark, database, "events", whole_month) == ["202311"]
    assert "202311" not in tables.partition_months(spark, database, "events")


def test_pruning_and_top_k_plans(spark, database):
    tables.append(A.spread_events(spark, SF), database, "events")
    stored = spark.table(f"{database}.events")
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-06"))
    plan = between(stored, start, end)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
    top = reads.latest_events(stored, 10, "proj-1")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "user_agent" not in top.split("ReadSchema")[1]


def test_backfill_is_repeatable(spark, database, tmp_path):
    events = A.dense_events(spark, SF)
    start, end, now = (F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-01-02", "2024-02-01"))
    for _ in range(2):
        parts = maintenance.backfill(events, "proj-1", start, end, now)
        maintenance.write_backfill(parts, database, str(tmp_path))
    daily = spark.read.parquet(f"{tmp_path}/daily_rollup")
    expected = events.filter("project_id = 'proj-1' AND timestamp < '2024-01-02'").count()
    assert daily.agg(F.sum("count")).first()[0] == expected


def test_cold_export_holds_what_expires(spark, tmp_path):
    events, policies = A.flat_events(spark, SF), D.policies(spark, SF)
    maintenance.export_cold(events, policies, A.as_of(), str(tmp_path / "cold"))
    cold = maintenance.cold_rows(events, policies, A.as_of())
    assert spark.read.parquet(str(tmp_path / "cold")).count() == cold.count() > 0


def test_conform_fills_and_orders(spark):
    old = spark.createDataFrame([("e", "click", "u")], "event_id STRING, type STRING, url STRING")
    row = tables.conform(old, "events")
    assert row.columns == [n for n, _ in tables.columns_of("events")]
    assert (row.first()["event_type"], row.first()["custom_name"]) == ("click", None)


def test_a_table_of_the_old_shape_is_migrated(spark, database):
    name = f"{database}.events"
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} (event_id STRING, type STRING, Timestamp TIMESTAMP, extra INT, month STRING) USING parquet PARTITIONED BY (month)")
    spark.sql(f"INSERT INTO {name} VALUES ('old', 'click', timestamp'2024-01-02', 1, '202401')")
    added = tables.migrate(spark, database, "events")
    assert "event_type" in added and "timestamp" not in added and tables.migrate(spark, database, "events") == []
    spark.sql(f"INSERT INTO {name} (event_id, event_type, timestamp, url, month) VALUES ('new', 'scroll', timestamp'2024-02-02', 'u', '202402')")
    rows = tables.read(spark, database, "events")
    assert rows.columns == [n for n, _ in tables.columns_of("events")] + ["month"]
    found = {tuple(r) for r in rows.select("event_id", "event_type", "url", "month").collect()}
    assert found == {("old", "click", None, "202401"), ("new", "scroll", "u", "202402")}
    assert tables.migrate_all(spark, database)["events"] == []


def test_a_column_of_another_type_stops_the_migration(spark, database):
    spark.sql(f"DROP TABLE {database}.events")
    spark.sql(f"CREATE TABLE {database}.events (event_id BOOLEAN, month STRING) USING parquet PARTITIONED BY (month)")
    with pytest.raises(ValueError, match="event_id"):
        tables.migrate(spark, database, "events")
    assert spark.table(f"{database}.events").columns == ["event_id", "month"]


def test_stream_to_table_and_maintenance(spark, database, tmp_path):
    """Streamed rows reach the events table once, and retention, deletion and reads work on them."""
    records = routing.broker_records(A.flat_events(spark, SF))
    paths = [str(tmp_path / d) for d in ("in", "events", "bad", "checkpoint")]
    records.select("value").write.parquet(paths[0])
    stream = spark.readStream.schema("value STRING").parquet(paths[0])
    for _ in range(2):
        sinks.run_to_end(ingest.ingest_stream(stream, *paths[1:], once=True))
        landed = sorted(loading.landed_epochs(spark, paths[1]))
        assert loading.load_epochs(spark, paths[1], database) == landed
    assert loading.load_epochs(spark, paths[1], database) == []
    # A replay of the first micro-batch brings nothing new.
    batch = spark.table(f"{database}.events")
    sinks.write_epoch(batch.filter("event_type = 'click'"), paths[1], 0, ["month"])
    assert loading.load_epochs(spark, paths[1], database) == []
    stored = spark.table(f"{database}.events")
    assert stored.count() == stored.select("event_id").distinct().count() == records.count()
    assert stored.filter("created_at IS NULL").count() == 0
    maintenance.delete_project(spark, database, "proj-3")
    left = spark.table(f"{database}.events")
    assert left.count() == A.flat_events(spark, SF).filter("project_id <> 'proj-3'").count()
    assert reads.count_events(left, "proj-3").first()[0] == 0
    maintenance.run_retention(spark, database, "2025-01-31")
    assert spark.table(f"{database}.events").count() == 0


def test_removal_by_tier(spark, database):
    tables.append(A.flat_events(spark, SF), database, "events")
    expected = maintenance.expire_by_tier(spark, database, D.policies(spark, SF), A.as_of()).count()
    before = spark.table(f"{database}.events").count()
    assert maintenance.remove_expired(spark, database, D.policies(spark, SF), A.as_of())
    assert spark.table(f"{database}.events").count() == expected < before
    assert maintenance.remove_expired(spark, database, D.policies(spark, SF), A.as_of()) == []


def test_compression_loses_no_event(spark, database, tmp_path):
    """Rollups and raw rows together count every event, over several runs, part days and late events."""
    path, policies = str(tmp_path / "rollup"), D.policies(spark, SF)
    tables.append(A.flat_events(spark, SF), database, "events")
    total = spark.table(f"{database}.events").count()

    def held():
        return spark.read.parquet(path).agg(F.sum("count")).first()[0] + spark.table(f"{database}.events").count()

    for as_of in ("2024-01-20 07:00:00", "2024-01-20 07:00:00", "2024-02-15 13:30:00"):
        maintenance.compress_and_remove(spark, database, policies, F.lit(as_of).cast("timestamp"), path)
        assert held() == total
    late = A.flat_events(spark, SF).withColumn("event_id", F.concat(F.lit("late-"), "event_id"))
    tables.append(late, database, "events")
    maintenance.compress_and_remove(spark, database, policies, F.lit("2024-02-16").cast("timestamp"), path)
    assert held() == 2 * total


def test_alerts_and_legacy_rows_are_stored(spark, database):
    found = quality.disk_alerts(D.disks(spark, "/root/testdata/sf0.01"), A.as_of())
    rows = legacy.flatten(legacy.decode(legacy_records(spark, SF)))
    for _ in range(2):
        tables.append(found, database, "alerts")
        tables.append(rows, database, "legacy_events")
    assert spark.table(f"{database}.alerts").count() == 2 * found.count() > 0
    assert spark.table(f"{database}.legacy_events").count() == 2 * rows.count() > 0
    assert tables.partition_months(spark, database, "legacy_events") == ["202401"]


def test_all_tables_of_a_stream_are_written(spark, database):
    events = A.flat_events(spark, SF, typed=True)
    for name, project in projections.PROJECTIONS.items():
        rows = project(events)
        tables.append(rows, database, name)
        assert spark.table(f"{database}.{name}").count() == rows.count() > 0
