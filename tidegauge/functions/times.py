"""Partition months and time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def month(ts: Column) -> Column:
    """Partition id: YYYYMM."""
    return F.date_format(ts, "yyyyMM")


def cutoff_month(as_of: Column, keep_months: int | Column) -> Column:
    """Oldest month that is kept; earlier partitions expire."""
    keep = F.lit(keep_months) if isinstance(keep_months, int) else keep_months
    return F.date_format(F.add_months(F.to_date(as_of), -keep), "yyyyMM")


def between(df: DataFrame, start: Column, end: Column, time: str = "timestamp") -> DataFrame:
    """Rows with ``start <= time < end``, with the month predicate that prunes partitions."""
    rows = df.filter((F.col(time) >= start) & (F.col(time) < end))
    if "month" in df.columns:
        rows = rows.filter(F.col("month").cast("string").between(month(start), month(end)))
    return rows
