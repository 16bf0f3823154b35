"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows of each input partition are counted; nothing else is read.
2. ``matrix[p, s]``, the rows that partition ``p`` sends to shard ``s``, is drawn from the law a uniform shuffle has.
   Shard sizes are exact, at most one apart. The partitions are halved again and again, and what the left half sends to
   each shard is a multivariate hypergeometric draw from what both halves send; its random numbers belong to the range of
   partitions, so any task can repeat it. The driver draws only ranges of 10**9 rows and more; each task draws the rest
   of its own range. What goes to the tasks is one count per partition and ``shards`` counts per 10**9 rows: some 7 MB
   for a million partitions and 10**13 rows.
3. Every partition permutes its own list of shard numbers and gives them to its rows, with a random key each.
4. Rows are exchanged on (shard, part of the shard); a shard has one part per ``PART_ROWS`` of its exact size. Each part
   permutes its rows by the keys; the exact sizes of the parts before it make the slots gapless.

Defined cases: an empty table gives no rows; fewer rows than shards leave shards empty; nulls and repeated rows are
placed like any other; other columns travel along. The input must deliver the same rows per partition each time it is
read (files or a written table); a partition whose count changed in between stops the job. Texts of any length travel as
they are. Columns may have any name; those named ``shard`` or ``slot`` give way to the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T, Window

PART_ROWS = 100_000


#: numpy draws hypergeometric numbers from populations below this; beyond, ``_by_inversion`` does.
NUMPY_ROWS = 10**9
_TERMS = 1 << 20


def shard_sizes(total: int, shards: int, seed: int) -> np.ndarray:
    sizes = np.full(shards, total // shards, np.int64)
    sizes[np.random.default_rng((seed, 0)).permutation(shards)[: total % shards]] += 1
    return sizes


class Range(NamedTuple):
    """Partitions ``first`` to ``last - 1`` and the rows they send to each shard together."""

    first: int
    last: int
    rows: np.ndarray


def halves(part: Range, ends: np.ndarray, seed: int) -> tuple[Range, Range]:
    """Both halves of a range; ``ends[p]`` is the number of rows before partition ``p``."""
    middle = (part.first + part.last) // 2
    rng = np.random.default_rng((seed, 2, part.first, part.last))
    left = _draw(rng, part.rows, int(ends[middle] - ends[part.first]))
    return Range(part.first, middle, left), Range(middle, part.last, part.rows - left)


def ranges(ends: np.ndarray, sizes: np.ndarray, seed: int, rows: int = NUMPY_ROWS) -> list[Range]:
    """Ranges in order, each of one partition or of fewer than ``rows`` rows."""
    found, open_ = [], [Range(0, len(ends) - 1, sizes)]
    while open_:
        part = open_.pop()
        if part.last - part.first > 1 and part.rows.sum() >= rows:
            open_ += reversed(halves(part, ends, seed))
        else:
            found.append(part)
    return found


def draw_row(part: Range, ends: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Rows that a partition of the range sends to each shard."""
    while part.last - part.first > 1:
        left, right = halves(part, ends, seed)
        part = left if partition < left.last else right
    return part.rows


def draw_matrix(counts: list[int], shards: int, seed: int, rows: int = NUMPY_ROWS) -> np.ndarray:
    """Exact partition-to-shard counts of a uniform shuffle, whole; the shuffle itself never holds it."""
    ends = np.cumsum([0, *counts])
    parts = ranges(ends, shard_sizes(int(ends[-1]), shards, seed), seed, rows) if counts else []
    found = [draw_row(part, ends, p, seed) for part in parts for p in range(part.first, part.last)]
    return np.array(found, np.int64).reshape(len(counts), shards)


def _draw(rng: np.random.Generator, lacking: np.ndarray, n: int) -> np.ndarray:
    """One draw of ``n`` without replacement from shards that lack so many rows each, shard by shard."""
    taken, rest = np.zeros(len(lacking), np.int64), int(lacking.sum())
    for s, good in enumerate(lacking.tolist()):
        rest -= good
        if n:
            draw = rng.hypergeometric if good + rest < NUMPY_ROWS else partial(_by_inversion, rng)
            taken[s] = draw(good, rest, n)
            n -= int(taken[s])
    return taken


def _by_inversion(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number, whatever the population: one uniform number against the summed probabilities.

    They follow from ratios of neighbours, in blocks, so memory stays bounded. Terms further from the mode than twelve
    deviations and sixty are left out; by Bernstein's bound all of them together weigh less than 1e-30.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))
    reach = int(12 * spread) + 60
    low, high = max(0, n - bad, mode - reach), min(good, n, mode + reach)

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        """First value of each block, and logarithms of its probabilities over that of ``low``."""
        log = 0.0
        for start in range(low, high + 1, _TERMS):
            k = np.arange(start, min(start + _TERMS, high + 1), dtype=float)
            steps = np.log((good - k) * (n - k) + (k == high)) - np.log((k + 1) * (bad - n + k + 1))
            logs = log + np.concatenate(([0.0], np.cumsum(steps)))
            log = logs[-1]
            yield start, logs[:-1]

    top = max(logs.max() for _, logs in blocks())
    sums = [np.exp(logs - top).sum() for _, logs in blocks()]
    left = rng.random() * sum(sums)
    for (start, logs), weight in zip(blocks(), sums):
        if left < weight or start + len(logs) > high:
            at = np.searchsorted(np.cumsum(np.exp(logs - top)), left, "right")
            return start + min(int(at), len(logs) - 1)
        left -= weight
    raise AssertionError("no block holds the number")


def uniform_shuffle(df: DataFrame, shards: int, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; rows of a part of a shard lie in one partition in the order of their slots."""
    spark = df.sparkSession
    found = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    ends = np.cumsum([0, *counts])
    sizes = shard_sizes(int(ends[-1]), shards, seed)
    drawn = ranges(ends, sizes, seed) if counts else []
    shared = spark.sparkContext.broadcast((ends, drawn, np.maximum(1, -(-sizes // part_rows))))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    names = ["shard", "part", "key"]
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("shard INT, part INT, key LONG").fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (ends, drawn, split) = TaskContext.get().partitionId(), shared.value
        part = next((part for part in drawn if part.first <= own < part.last), None)
        row = draw_row(part, ends, own, seed) if part else np.zeros(shards, np.int64)
        rng = np.random.default_rng((seed, 1, own))
        labels, at = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), row)), 0
        for batch in batches:
            shard = labels[at : at + batch.num_rows]
            at += batch.num_rows
            if len(shard) < batch.num_rows:
                break
            part = (rng.random(len(shard)) * split[shard]).astype(np.int32)
            key = rng.integers(0, 2**63 - 1, len(shard))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard), pa.array(part), pa.array(key)], names=["row", *names]
            )
        if at != len(labels):
            raise RuntimeError(f"partition {own} had {len(labels)} rows when counted, now another number")

    dealt = packed.mapInArrow(deal, schema)
    # Both passes below see the same deal: it is a function of the seed and of the partition's rows.
    part_sizes = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("key")
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return (
        dealt.join(offsets, ["shard", "part"])
        .withColumn("rank", F.row_number().over(inside))
        .select(
            *[F.col(f"row.`{c}`").alias(c) for c in own],
            "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
        )
    )
