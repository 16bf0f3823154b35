"""Running totals over keys that may hold a large share of all rows: a distributed prefix scan.

1. Rows are range-partitioned by key and order, so a key of any size spreads over as many tasks as it needs, and sorted
   within their partition. A narrow pass adds the running values inside the partition and is written once.
2. What came before a partition follows from one row per partition, its last key and that key's total.
3. A second narrow pass adds it to the rows of the partition's first key.

One shuffle and one sort; no self-join, and no task holds more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegralType, LongType, StructField, StructType

from tidegauge.session import shared_dir, ship_package

_IDENTITY = {"sum": lambda kind: 0, "max": lambda kind: np.iinfo(np.int64).min if pa.types.is_integer(kind) else -np.inf}


def _same_as_before(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each value equals the one before it; null equals null."""
    before = pa.array([None if last is None else last.as_py()], column.type)
    shifted = pa.concat_arrays([before, column.slice(0, len(column) - 1)])
    equal = pc.fill_null(pc.equal(column, shifted), False).to_numpy(zero_copy_only=False)
    both_null = pc.and_(pc.is_null(column), pc.is_null(shifted)).to_numpy(zero_copy_only=False)
    return equal | both_null


class _Scan:
    """Running values of the rows of one partition, batch after batch."""

    def __init__(self, keys: list[str], values: list[str], combine: str):
        self.keys, self.values, self.combine = keys, values, combine
        self.last: dict[str, pa.Scalar] | None = None
        self.head = True  # still at the partition's first key
        self.held: dict[str, tuple] = {}  # of the last key: its total, and whether it has one

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Whether each row has the partition's first key, and the running values."""
        same = np.ones(batch.num_rows, bool)
        for key in self.keys:
            same &= _same_as_before(batch.column(key), None if self.last is None else self.last[key])
        if self.last is None:
            same[0] = True  # the first key goes on from nothing
        segment = np.cumsum(~same)
        head = (segment == 0) & self.head
        found = {}
        for name in self.values:
            column = batch.column(name)
            empty = _IDENTITY[self.combine](column.type)
            numbers = pc.fill_null(column, empty).to_numpy(zero_copy_only=False)
            groups = pd.Series(numbers).groupby(segment)
            running = (groups.cumsum() if self.combine == "sum" else groups.cummax()).to_numpy().copy()
            some = pd.Series(column.is_valid().to_numpy(zero_copy_only=False)).groupby(segment).cummax().to_numpy().copy()
            first = segment == 0
            if name in self.held and first.any():
                total, had = self.held[name]
                running[first] = running[first] + total if self.combine == "sum" else np.maximum(running[first], total)
                some[first] |= had
            self.held[name] = (running[-1], some[-1])
            found[name] = pa.array(running, column.type, mask=~some)
        self.last = {key: batch.column(key)[batch.num_rows - 1] for key in self.keys}
        self.head = bool(head[-1])
        return head, found


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], combine: str) -> DataFrame:
    """Add running aggregates per key, in ``order``: ``values`` maps output name to input, whole numbers or doubles.

    ``combine`` is "sum" or "max"; null values are passed over, and the result is null until a value came. A null key is
    a key, and null comes first in the order. Rows equal in key and order stay together. No row is lost.
    """
    spark = df.sparkSession
    ship_package(spark)
    names = {out: f"_{out}" for out in values}
    rows = df.withColumns({names[out]: value for out, value in values.items()})
    whole = [c for c in names.values() if isinstance(rows.schema[c].dataType, IntegralType)]
    rows = rows.withColumns({c: F.col(c).cast("bigint" if c in whole else "double") for c in names.values()})
    by = [F.col(f"`{c}`") for c in [*keys, *order]]
    # The partition's number: ranges ascend with it.
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields, StructField("_head", BooleanType()), StructField("_row", LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, done = _Scan(keys, list(names.values()), combine), 0
        for batch in batches:
            if batch.num_rows:
                head, running = scan.step(batch)
                columns = [running.get(name, batch.column(name)) for name in batch.schema.names]
                place = pa.array(np.arange(done, done := done + batch.num_rows))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(head), place], names=schema.names)

    path = f"{shared_dir(spark, 'prefix')}/rows"
    ranged.mapInArrow(local, schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)

    def total(c: str) -> Column:
        return (F.sum(c) if combine == "sum" else F.max(c)).over(of_key).alias(c)

    # One row per partition: its last key with that key's total, and what the keys before it leave to its first key.
    at = F.struct("_row", *[F.col(f"`{c}`") for c in [*keys, *names.values()]])
    ends = stored.groupBy("_part").agg(F.max(at).alias("end"), F.min(at).alias("begin"))
    key_of = lambda side: F.struct(*[F.col(f"{side}.`{k}`") for k in keys]) if keys else F.struct(F.lit(1).alias("all"))
    ends = ends.select("_part", key_of("end").alias("last"), key_of("begin").alias("first"), *[f"end.`{c}`" for c in names.values()])
    of_key = Window.partitionBy("last").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    sums = ends.select("_part", "first", "last", *[total(c) for c in names.values()])
    by_part = Window.orderBy("_part")
    goes_on = F.lag("last").over(by_part) == F.col("first")
    offsets = sums.select(
        "_part", *[F.when(goes_on, F.lag(c).over(by_part)).alias(f"{c}_before") for c in names.values()]
    )

    def running(column: str) -> Column:
        before, own = F.when(F.col("_head"), F.col(f"{column}_before")), F.col(column)
        if combine == "sum":
            return F.when(before.isNull(), own).otherwise(before + F.coalesce(own, F.lit(0)))
        return F.greatest(before, own)

    # one row for each task of the shuffle
    joined = stored.join(F.broadcast(offsets), "_part")
    return joined.select(*[f"`{c}`" for c in df.columns], *[running(c).alias(out) for out, c in names.items()])
