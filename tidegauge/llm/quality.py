"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

Features are hashed into three families of buckets: byte n-grams of 3 to 5 with blanks and case, words between blanks,
and word pairs, where a word that follows itself is one feature whatever the word. Each bucket has a learned vector; a
document is the sum of the families' averages, a softmax over two classes follows. The model is linear in the vectors,
so scoring uses one number per bucket, and a pass over a text needs no Python loop over its words.

Training rows are a sample of at most ``TRAIN_ROWS`` labelled rows per class, spread by hash; the classes are balanced.
Their texts are taken whole. Labels, language, source and id are not inputs.

Defined cases: null is the empty text; without features the score is that of the bias. Without training rows of both
classes every score is 0.5. Equal texts get equal scores; repeated rows are scored each. Extra columns are dropped
unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import words as W
from tidegauge.llm.common import text_passes

TRAIN_ROWS, EPOCHS, BATCH, DIM, RATE = 1500, 4, 16, 4, 0.1
FAMILY_BITS, GRAMS = 16, (3, 4, 5)
_U = np.uint64
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
_REPEAT = np.array([1], _U)


def _bucket(hashes: np.ndarray, family: int) -> np.ndarray:
    return (hashes >> _U(64 - FAMILY_BITS)).astype(np.int64) + (family << FAMILY_BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(family, buckets, first of each row with the end)``, once for each kind of feature."""
    wide = np.concatenate((data, np.zeros(GRAMS[-1], np.uint8))).astype(_U)
    packed, n = np.zeros(len(data), _U), 0
    sizes = np.diff(offsets)
    for size in GRAMS:
        while n < size:
            packed |= wide[n : n + len(data)] << _U(8 * n)
            n += 1
        rows = np.maximum(sizes - size + 1, 0)
        inside = np.ones(len(data), bool)
        for back in range(1, size):
            ends = offsets[1:] - back
            inside[ends[ends >= offsets[:-1]]] = False
        yield 0, _bucket((packed[inside] + _U(size)) * _U(0x9E3779B97F4A7C15), 0), np.concatenate(([0], np.cumsum(rows)))
    spans = W.spans(data, offsets, _NOT_BLANK)
    hashes = W.span_hashes(W.LETTERS[data], spans.starts, spans.ends)
    yield 1, _bucket(hashes, 1), np.concatenate(([0], np.cumsum(spans.counts)))
    pairs = np.flatnonzero(spans.rows[:-1] == spans.rows[1:])
    left, right = hashes[pairs], hashes[pairs + 1]
    both = W.mix(np.where(left == right, _REPEAT, left + _U(3) * right))
    yield 2, _bucket(both, 2), np.concatenate(([0], np.cumsum(np.maximum(spans.counts - 1, 0))))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The sum of each row's values, the same wherever the row stands in a pass."""
    sums, some = np.zeros(len(cuts) - 1), np.flatnonzero(cuts[:-1] < cuts[1:])
    if len(some):
        sums[some] = np.add.reduceat(values, cuts[some])
    return sums


def score(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each row."""
    sums, counts = np.zeros((3, len(offsets) - 1)), np.zeros((3, len(offsets) - 1))
    for family, buckets, cuts in features(data, offsets):
        sums[family] += _sums(weights[buckets], cuts)
        counts[family] += np.diff(cuts)
    logit = bias + (sums / np.maximum(counts, 1)).sum(axis=0)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their shares."""
    raw = np.frombuffer(text.encode(), np.uint8)
    parts: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}
    for family, buckets, _ in features(raw, np.array([0, len(raw)])):
        parts[family].append(buckets)
    ids, shares = [], []
    for family in parts.values():
        found, counts = np.unique(np.concatenate(family), return_counts=True)
        ids.append(found)
        shares.append(counts / max(1, counts.sum()))
    return np.concatenate(ids).astype(np.int32), np.concatenate(shares).astype(np.float32)


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weight per bucket and bias of the log-odds of label 1."""
    size = 3 << FAMILY_BITS
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return np.zeros(size, np.float32), 0.0
    rng = np.random.default_rng(seed)
    docs = [_row(text) for text, _ in rows]
    balance = len(rows) / (2 * np.bincount(labels, minlength=2))
    vectors = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias, seen, seen_out = np.zeros(2), np.full((size, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), BATCH):
            batch = order[k : k + BATCH]
            ids = np.concatenate([docs[i][0] for i in batch])
            shares = np.concatenate([docs[i][1] for i in batch])
            cuts = np.concatenate(([0], np.cumsum([len(docs[i][0]) for i in batch])))
            hidden = np.stack([_sums(vectors[ids, d] * shares, cuts) for d in range(DIM)], axis=1)
            logits = hidden @ out + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), labels[batch]] -= 1
            error *= balance[labels[batch]][:, None] / len(batch)
            back = error @ out.T
            step = hidden.T @ error
            seen_out += step**2
            out -= (RATE * step / np.sqrt(seen_out)).astype(np.float32)
            bias -= RATE * error.sum(axis=0)
            used, place = np.unique(ids, return_inverse=True)
            rows_of = np.repeat(np.arange(len(batch)), np.diff(cuts))
            for d in range(DIM):
                step = np.bincount(place, shares * back[rows_of, d], minlength=len(used)).astype(np.float32)
                seen[used, d] += step**2
                vectors[used, d] -= RATE * step / np.sqrt(seen[used, d])
    toward = out[:, 1] - out[:, 0]
    return (vectors @ toward).astype(np.float32), float(bias[1] - bias[0])


def classify(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for start, stop, data, offsets in text_passes(batch.column(batch.num_columns - 1)):
                found = score(data, offsets, weights, bias)
                own = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(found), pa.array(found >= 0.5).cast(pa.int32())],
                    names=[*batch.schema.names[:-1], "score", "predicted"],
                )

    return rows.mapInArrow(run, f"{kept}, score DOUBLE, predicted INT")
