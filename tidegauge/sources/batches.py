"""Reading raw request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schemas as S

FORMATS = ("parquet", "orc", "json", "avro")


def read_raw_batches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the ``raw_batch`` shape; missing header columns come back null."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    return spark.read.format(fmt).schema(S.RAW_BATCH).load(path)


def read_body_lines(spark: SparkSession, path: str, project_id: str, received_at: str) -> DataFrame:
    """One request body per text line, all of one project and arrival time.

    The id is a hash of file and body, so a re-read gives the same ids.
    """
    body = F.col("value")
    return spark.read.text(path).select(
        F.xxhash64(F.col("_metadata.file_path"), body).alias("batch_id"),
        F.lit(project_id).alias("project_id"),
        body.alias("body"),
        F.lit(received_at).cast("timestamp").alias("received_at"),
    )
