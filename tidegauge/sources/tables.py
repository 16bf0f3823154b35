"""Tables: creation, schema evolution, appends, partition rewrites.

Every table is Parquet, partitioned by ``month`` and ordered inside a partition
by its sort key, so that filters on project and time skip files and row groups.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from tidegauge.functions.times import month
from tidegauge.session import shared_dir

log = logging.getLogger(__name__)


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in S.TABLES[table].split(",")]


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the database and all tables if absent; existing ones stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in S.TABLES.items():
        columns = ddl.replace("column BIGINT", "`column` BIGINT")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, month STRING) "
            "USING parquet PARTITIONED BY (month)"
        )


def migrate(spark: SparkSession, database: str, table: str) -> list[str]:
    """Bring an existing catalog table to today's columns: what is missing is added, nothing is dropped or rewritten.

    Returns the columns added, none on the second call. Files written before keep their layout; ``read`` fills what they
    lack. A column that exists with a type that does not widen to today's is an error, before anything is changed.
    """
    name = f"{database}.{table}"
    present = {f.name.lower(): f.dataType.simpleString() for f in spark.table(name).schema.fields}
    wanted = columns_of(table)
    for column, kind in wanted:
        old, new = present.get(column.lower()), kind.lower()
        widens = {("int", "bigint"), ("smallint", "bigint"), ("smallint", "int"), ("float", "double"), ("date", "timestamp")}
        if old is not None and old != new and (old, new) not in widens:
            raise ValueError(f"{name}.{column} is {old}, not {new}")
    missing = [(column, kind) for column, kind in wanted if column.lower() not in present]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c}` {k}' for c, k in missing)})")
    return [c for c, _ in missing]


def migrate_all(spark: SparkSession, database: str) -> dict[str, list[str]]:
    """Migrate every table that exists; the columns added to each."""
    return {t: migrate(spark, database, t) for t in S.TABLES if spark.catalog.tableExists(f"{database}.{t}")}


def read(spark: SparkSession, database: str, table: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """A table's columns with ``month``, whatever layout its files have; see ``conform`` for older names."""
    rows = spark.table(f"{database}.{table}")
    names = [F.col(n) for n, _ in columns_of(table)]
    return conform(rows.withColumn("_month", F.col("month")), table, defaults, keep=("_month",)).select(
        *names, F.col("_month").alias("month")
    )


def conform(
    rows: DataFrame, table: str, defaults: dict[str, Column] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Bring rows to a table's columns: add missing ones, order, cast. Idempotent. ``keep`` names others to stay.

    Older event rows carry ``type`` instead of ``event_type``.
    """
    defaults = dict(defaults or {})
    if table == "events" and "type" in rows.columns:
        defaults.setdefault("event_type", F.col("type"))
    selected = []
    for name, kind in columns_of(table):
        default = defaults.get(name, F.lit(None))
        value = F.coalesce(F.col(name), default) if name in rows.columns else default
        selected.append(value.cast(kind).alias(name))
    return rows.select(*selected, *keep)


def arranged(rows: DataFrame, table: str) -> DataFrame:
    """Add ``month`` and order rows for writing."""
    name = S.PARTITION_TIME[table]
    time = F.timestamp_millis(name) if dict(rows.dtypes)[name] == "bigint" else F.col(name)
    with_month = rows.withColumn("month", month(time))
    return with_month.sortWithinPartitions("month", *S.SORT_KEYS[table])


def append(rows: DataFrame, database: str, table: str) -> None:
    """Append rows to a catalog table."""
    ordered = arranged(conform(rows, table), table)
    ordered.write.mode("append").insertInto(f"{database}.{table}")


def replace_partitions(rows: DataFrame, database: str, table: str) -> None:
    """Overwrite exactly the month partitions that ``rows`` contain."""
    ordered = arranged(conform(rows, table), table)
    spark, setting = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    # A write option is not honoured by insertInto, only the session setting is.
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        ordered.write.mode("overwrite").insertInto(f"{database}.{table}")
    finally:
        spark.conf.set(setting, before)


def drop_partitions(spark: SparkSession, database: str, table: str, months: list[str]) -> None:
    for value in months:
        spark.sql(f"ALTER TABLE {database}.{table} DROP IF EXISTS PARTITION (month = '{value}')")


def partition_months(spark: SparkSession, database: str, table: str) -> list[str]:
    """Months of a table from the catalog, without reading data."""
    rows = spark.sql(f"SHOW PARTITIONS {database}.{table}").collect()
    return sorted(r[0].removeprefix("month=") for r in rows)


def delete_where(spark: SparkSession, database: str, table: str, doomed: Column) -> list[str]:
    """Remove the rows matching ``doomed``; see ``delete_marked``."""
    return delete_marked(spark, database, table, lambda rows: rows.withColumn("expired", doomed))


def delete_marked(
    spark: SparkSession, database: str, table: str, mark: Callable[[DataFrame], DataFrame]
) -> list[str]:
    """Remove rows by rewriting only the months that hold any. ``mark`` adds a boolean ``expired``.

    Survivors are written aside, then replace their months; months left empty are
    dropped last. A reader never misses a survivor. After a failure the copy is in
    the logged folder; after success it is removed. Returns the months rewritten.
    """
    name = f"{database}.{table}"
    rows = spark.table(name)
    months = [r["month"] for r in mark(rows).filter("expired").select("month").distinct().collect()]
    if not months:
        return []
    staged = shared_dir(spark, f"rewrite-{table}")
    keep = mark(rows.filter(F.col("month").isin(months))).filter(~F.coalesce("expired", F.lit(False)))
    keep = keep.select(*rows.columns)
    keep.write.parquet(staged)
    log.info("survivors of %s in %s are in %s", name, months, staged)
    copy = spark.read.schema(keep.schema).parquet(staged)
    left = {r["month"] for r in copy.select("month").distinct().collect()}
    if left:
        replace_partitions(copy.drop("month"), database, table)
    drop_partitions(spark, database, table, [m for m in months if m not in left])
    remove_folder(spark, staged)
    return sorted(months)


def _filesystem(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    folder, filesystem = _filesystem(spark, path)
    filesystem.delete(folder, True)


def finished_folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Sub-folders whose name starts with ``prefix`` and whose write has been committed."""
    folder, filesystem = _filesystem(spark, path)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{prefix}*/_SUCCESS")
    return sorted(str(s.getPath().getParent().toString()) for s in filesystem.globStatus(pattern) or [])


def folders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """What lies in a folder under a name like ``pattern``; nothing if there is no such folder."""
    folder, filesystem = _filesystem(spark, path)
    found = filesystem.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)) or []
    return sorted(str(s.getPath().toString()) for s in found)


def exists(spark: SparkSession, path: str) -> bool:
    file, filesystem = _filesystem(spark, path)
    return filesystem.exists(file)


def rename(spark: SparkSession, path: str, target: str) -> None:
    """Move a file; what a broken move left at the target goes first."""
    file, filesystem = _filesystem(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(target)
    filesystem.mkdirs(new.getParent())
    filesystem.delete(new, False)
    if not filesystem.rename(file, new):
        raise OSError(f"cannot rename {path} to {target}")


def location(spark: SparkSession, database: str, table: str) -> str:
    """The folder of a catalog table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{table}").where("col_name = 'Location'")
    return rows.first()["data_type"].rstrip("/")


def fresh_database(spark: SparkSession, name: str, path: str) -> str:
    """An empty database under ``path`` with all tables; an older one of that name goes with its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    create_tables(spark, name)
    return name


def truncate(spark: SparkSession, database: str, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {database}.{table}")
