"""Helpers of the training-data operators: text columns as byte arrays, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidegauge.session import shared_dir

#: Bytes of text that one numpy pass works on; its arrays take some hundred times as much at most.
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, root: str, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later steps read it, however often, without the lineage."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, purpose: str) -> str:
    return shared_dir(spark, purpose)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def text_passes(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, past the last row, bytes, offsets)`` of each pass over a text column."""
    data, offsets = utf8(column)
    for start, stop in passes(offsets):
        own = offsets[start : stop + 1]
        yield start, stop, data[own[0] : own[-1]], own - own[0]
