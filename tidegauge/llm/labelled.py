"""Labelled rows for the classifiers: a bounded, balanced sample, and the test rows that are never learned from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


from tidegauge.llm import words as W


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without most exact and near copies, which would make a text's words look like those of its class.

    Rows of a class go that share the least or the greatest hash of their five-word shingles with an earlier one.
    """
    seen: set[tuple] = set()
    kept = []
    for text, label in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        grams = W.row_shingles(raw, np.array([0, len(raw)]), 5)[0]
        ends = [(label, k, int(x)) for k, x in enumerate((grams[0], grams[-1]))] if len(grams) else [(label, text)]
        if not seen.intersection(ends):
            kept.append((text, label))
        seen.update(ends)
    return kept


def remainder(parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> list[tuple[str, int]]:
    """``(text, label)`` of at most ``rows`` rows per class, in an order that does not depend on the partitions.

    Ids are chosen from the labels first; only their texts are fetched. ``rows`` bounds what comes to the driver.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(usable & F.col("label").isin(0, 1))
    marks = marks.dropna().distinct()
    found: list[tuple[str, int]] = []
    for value in (0, 1):
        ids = marks.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        # at most `rows` ids: their size is bounded by the parameter
        chosen = texts.join(F.broadcast(ids.select("doc_id")), "doc_id")
        chosen = chosen.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(rows)
        found += [(r["text"], value) for r in chosen.select("text").collect()]
    return without_copies(found)
