"""Spelling variant grouping with PartEnum signatures over letter multisets.

A word is a binary vector: its dimension ``(letter, k)`` is 1 if the word holds the letter at least ``k`` times. One
inserted, deleted or replaced code point changes at most two dimensions. The dimensions are dealt over ``PARTS`` parts;
a change of at most two leaves ``PARTS - 2`` parts as they are, so two near words agree on the signature of at least one
choice of that many parts (partition, then enumerate the choices). No near pair is missed.

An edit also leaves one half of a word alone: with L the longer length, the words share their first or their last
``ceil((L - 1) / 2)`` code points. That half and L are part of the signature, so words of the same letters in another
order rarely meet. Each word takes L for its own length and for one more.

1. Runs of letters are exploded, changed by the rule below, and summed per word; partial sums come before the shuffle.
2. Signatures are computed by array operations over all words of a batch. Their table is partitioned once: group sizes,
   the drop of lone entries and the equi-join all use that partitioning. Groups of more than ``HOT`` words are joined in
   blocks by salt, each block on its own.
3. Candidates are verified by exact edit distance inside the join; only near pairs leave it.
4. A word's form is its near word of greatest count, if that is at least ``RATIO`` times its own. Roots follow forms by
   pointer doubling; a step multiplies the count by ``RATIO``, which bounds the rounds.

Rule of changed runs (plants spelling variants in a table): with h the unsigned crc32 of ``<doc_id>:<lower-cased run>``,
``every`` dividing h deletes the run's code point ``h % length``. ``every=0`` changes nothing.

Defined cases: a null or empty text has no runs; a null id is written as the empty text. Rows are counted each, repeated
ones too. Texts are taken whole. Ties between forms go to the smallest word in code-point order. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from tidegauge.llm.common import scratch, stored, utf8
from tidegauge.llm.words import mix, span_hashes

PARTS, MOST_CHANGES = 4, 2
MIN_CHARS, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: Words of one signature that are compared in one block.
HOT = 2000
_U = np.uint64
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """``word, n``: words of enough code points and occurrences.

    A shorter run cannot become a word, so only runs of ``min_chars`` leave the pattern.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", _A_Z, _a_z).alias("run"))
    word = F.col("run")
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).cast("long"))
        cut = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
        word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word"))
        .where(F.length("word") >= min_chars)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


def signature_table(column: pa.Array) -> np.ndarray:
    """All signatures of each word of a text column, one row a word."""
    data, offsets = utf8(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    starts = np.searchsorted(at, offsets[:-1])
    sizes = np.diff(np.append(starts, len(points)))
    word = np.repeat(np.arange(len(sizes)), sizes)
    letters = points[np.lexsort((points, word))]
    fresh = np.ones(len(points), bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    turn = np.arange(len(points)) - np.maximum.accumulate(np.where(fresh, np.arange(len(points)), 0))
    value = mix((letters << 32 | turn).astype(_U) + _U(0x9E3779B97F4A7C15))
    part = (value >> _U(32)) % _U(PARTS)
    full = np.flatnonzero(sizes)  # only the empty word has no code points
    sums = np.zeros((PARTS, len(sizes)), _U)
    for k in range(PARTS):
        if len(full):
            sums[k, full] = np.add.reduceat(np.where(part == k, value, _U(0)), starts[full])
    chosen = [
        mix(sum(mix(sums[k] + _U(k + 1)) for k in own) + _U(1000 + number))
        for number, own in enumerate(combinations(range(PARTS), PARTS - MOST_CHANGES))
    ]
    place, found = mix(points.astype(_U) + _U(77)), []
    for longest in (sizes, sizes + 1):
        half = np.minimum(longest // 2, sizes)  # ceil((longest - 1) / 2)
        ends = (span_hashes(place, starts, starts + half), span_hashes(place, starts + sizes - half, starts + sizes))
        for side, end in enumerate(ends):
            own = mix(end + (2 * longest + side).astype(_U))
            found += [mix(own ^ choice) for choice in chosen]
    return np.stack(found, axis=1).view(np.int64)


def signatures(words: DataFrame) -> DataFrame:
    """``sig, word, n``: a row for each signature of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = signature_table(batch.column(0))
            again = pa.array(np.repeat(np.arange(table.shape[0]), table.shape[1]))
            columns = [pa.array(table.ravel()), *(c.take(again) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "sig LONG, word STRING, n LONG")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``a, an, b, bn`` with ``a < b``: every pair of words one edit apart, once, with their counts."""
    sized = signatures(words).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("sig")))
    shared = sized.where("held > 1")
    near = F.expr("a < b AND abs(length(a) - length(b)) <= 1 AND levenshtein(a, b, 1) = 1")
    left = lambda rows, *more: rows.select("sig", *more, F.col("word").alias("a"), F.col("n").alias("an"))
    right = lambda rows, *more: rows.select("sig", *more, F.col("word").alias("b"), F.col("n").alias("bn"))
    small = shared.where(F.col("held") <= hot)
    large = shared.where(F.col("held") > hot).withColumn("blocks", F.ceil(F.col("held") / hot))
    block = F.pmod(F.xxhash64("word"), "blocks").alias("block")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    met = left(small).join(right(small), "sig").where(near).select("a", "an", "b", "bn")
    split = left(large, block).join(right(large, each), ["sig", "block"]).where(near).select("a", "an", "b", "bn")
    return met.union(split).distinct()


def group_variants(words: DataFrame, root: str, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` ``(word, n)``; ``words`` are distinct."""
    pairs = near_pairs(words, hot)
    both = pairs.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("m"))
    both = both.union(pairs.select("b", "bn", "a", "an"))
    best = F.min(F.when(F.col("m") >= ratio * F.col("n"), F.struct((-F.col("m")).alias("m"), "other")))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = found.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))
    found = stored(found, root, "near")
    links = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), root, "root-0")
    # A chain of s forms needs a count of at least ratio ** s.
    steps = max(1, ceil(log(max(2, words.agg(F.max("n")).first()[0] or 2), ratio)))
    for turn in range(ceil(log2(steps))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(
            links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), root, f"root-{turn + 1}"
        )
    return (
        words.select("word", "n")
        .join(found, "word", "left")
        .join(links, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            "form_n",
        )
    )


def spelling_variants(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    every: int = EVERY,
    root: str | None = None,
) -> DataFrame:
    """Words of ``docs`` ``(doc_id, text)`` with their counts, near words, forms and roots."""
    root = root or scratch(docs.sparkSession, "spelling")
    words = stored(count_words(docs, min_chars, min_count, every), root, "words")
    return group_variants(words, root, ratio)
