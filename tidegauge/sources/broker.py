"""Reading and writing broker records. The source format is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader

from tidegauge import schemas as S
from tidegauge.functions.once import with_columns_once
from tidegauge.functions.seals import sealed, unsealed

#: The largest distance from 1970, in milliseconds, of a time that fits the TIMESTAMP type.
MAX_TIME_MS = 2**63 // 1000 - 1
_FIELDS = [part.split() for part in S.BROKER_RECORD.split(",")]
_STRICT = "struct<" + ", ".join(f"{n} {'bigint' if t == 'BIGINT' else 'binary'}" for n, t in _FIELDS) + ">"
_PRESENT = "struct<" + ", ".join(f"{n} variant" for n in ["timestamp", *S.BROKER_OPTIONAL]) + ">"


def flush_options(per_trigger: int | None = None, at_least: int | None = None, max_age: str | None = None) -> dict[str, str]:
    """Reader options: a micro-batch starts at ``at_least`` records or when the oldest waits for ``max_age``, and takes
    at most ``per_trigger``."""
    if (at_least is None) != (max_age is None):
        raise ValueError("at_least and max_age go together")
    values = {"maxOffsetsPerTrigger": per_trigger, "minOffsetsPerTrigger": at_least, "maxTriggerDelay": max_age}
    return {name: str(value) for name, value in values.items() if value is not None}


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    per_trigger: int | None = None,
    at_least: int | None = None,
    max_age: str | None = None,
) -> DataFrame:
    """Records of a topic, from the latest offsets on the first start; see ``flush_options`` for the sizes.

    Needs the Spark Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    return reader.options(**flush_options(per_trigger, at_least, max_age)).load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("arrived_at")
    )


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    reader: DataStreamReader = spark.readStream.format(fmt).schema(schema)
    return reader.options(**options).load(path)


def write_kafka(records: DataFrame, servers: str, topic: str, codec: str = "lz4") -> None:
    """Publish ``key`` and ``value``; a failed write fails the job."""
    if codec not in ("none", "gzip", "snappy", "lz4", "zstd"):
        raise ValueError(f"unknown codec {codec}")
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.compression.type", codec)
        .option("kafka.acks", "all")
        .option("topic", topic)
        .save()
    )


def decode_records(records: DataFrame, value: str = "value") -> DataFrame:
    """Decode each JSON value to the flat row; ``malformed`` marks records that do not fit.

    Text must be JSON strings, the time a JSON integer that a timestamp can hold;
    only the four optional fields may be null or missing.
    """
    text = F.col(value)
    parsed = records.withColumn("_doc", sealed(text)).withColumn("_doc", unsealed(F.col("_doc"), text))
    typed = with_columns_once(
        parsed,
        {
            "_row": F.try_variant_get("_doc", "$[0]", _STRICT),
            "_seen": F.try_variant_get("_doc", "$[0]", _PRESENT),
        },
    )
    in_range = F.coalesce(F.col("_row.timestamp").between(-MAX_TIME_MS, MAX_TIME_MS), F.lit(False))
    ok = in_range & F.coalesce(F.schema_of_variant("_seen.timestamp") == "BIGINT", F.lit(False))
    for name, _ in _FIELDS:
        got = F.col(f"_row.{name}")
        if name in S.BROKER_OPTIONAL:
            seen = F.col(f"_seen.{name}")
            ok = ok & (got.isNotNull() | seen.isNull() | F.coalesce(F.is_variant_null(seen), F.lit(False)))
        elif name != "timestamp":
            ok = ok & got.isNotNull()
    columns = []
    for name, kind in _FIELDS:
        column = F.col(f"_row.{name}")
        if name == "timestamp":
            column = F.timestamp_millis(F.when(in_range, column))
        else:
            column = column.cast("string")
        columns.append(column.alias("event_type" if name == "type" else name))
    return typed.select(*records.columns, (~ok).alias("malformed"), *columns)


def good_records(decoded: DataFrame) -> DataFrame:
    names = ["event_type" if n == "type" else n for n, _ in _FIELDS]
    return decoded.filter(~F.col("malformed")).select(*names)


def bad_records(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.filter("malformed").select(value)
