"""Columns that must not be evaluated twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but a later filter on them is not pushed below.

    The optimizer replaces a column in a filter by its expression and moves the
    filter down; for a parsed document that would mean parsing once more per
    mention. A generated row is a boundary it does not cross.
    """
    item = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, item).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])
