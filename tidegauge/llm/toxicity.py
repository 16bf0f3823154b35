"""Toxicity classifier with a counterfactual penalty.

A word's score is the sum of learned weights of its features: the word, and its first 4, 5 and 6 bytes, which stand for
inflected forms. The log-odds of a text are a bias plus the positive scores of its ``TOP`` highest words, so
length does not dilute a text and a long clean text gathers no noise. Weights start from how the classes differ in
document counts, features of few texts left out, and are refined by gradient descent on the logistic loss.

The counterfactual penalty: in every labelled text identity terms are swapped for other ones (a text without any gets a
mention), and the squared change of the log-odds is added to the loss. Naming a group so moves no score, whatever the
labels say about texts that name it.

Training rows are a sample of at most ``TRAIN_ROWS`` labelled rows per class, spread by hash, with whole texts. Labels,
language, source and id are not inputs.

Defined cases: null is the empty text; a text without words has the score of the bias. Without training rows of both
classes every score is 0. Repeated rows are scored each. Extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import words as W
from tidegauge.llm.common import passes, text_passes

TRAIN_ROWS, EPOCHS, RATE, PENALTY, TOP = 2500, 6, 0.1, 1.0, 3
PREFIXES = (4, 5, 6)
#: A feature is used from so many texts of label 1 on, and such smoothed log-odds: with classes of one size and no text of
#: label 0 that takes 11 texts, however large the sample.
LEAST_TEXTS, LEAST_ODDS = 3, 1.5
_SMOOTH, _MARGIN, _FILTER_BITS = 3.0, 2.0, 20
_U = np.uint64
#: Terms for groups of people; any of them may stand for any other.
IDENTITY = (
    "muslim christian jewish hindu buddhist atheist black white asian latino african european gay lesbian straight "
    "bisexual trans women men woman man girls boys immigrants refugees disabled deaf blind elderly young"
).split()


class Model(NamedTuple):
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float


def word_features(data: np.ndarray, spans: W.Words) -> np.ndarray:
    """Feature hashes of each word, one row per kind; a word shorter than a prefix has 0 there."""
    values = W.LETTERS[W.LOWER[data]]
    found = np.zeros((1 + len(PREFIXES), len(spans.starts)), _U)
    found[0] = W.span_hashes(values, spans.starts, spans.ends)
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(spans.ends - spans.starts >= size)
        found[k, long] = W.mix(W.span_hashes(values, spans.starts[long], spans.starts[long] + size) + _U(k))
    return found


def _filter(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(keys & _U(len(bits) - 1)).astype(np.int64)] = True
    return bits


def word_scores(found: np.ndarray, model: Model, bits: np.ndarray) -> np.ndarray:
    """The part of each word in the log-odds; 0 for most."""
    total = np.zeros(found.shape[1])
    if not len(model.keys):
        return total
    for hashes in found:
        maybe = np.flatnonzero(bits[(hashes & _U(len(bits) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(model.keys, hashes[maybe]), len(model.keys) - 1)
        hit = model.keys[at] == hashes[maybe]
        total[maybe[hit]] += model.weights[at[hit]]
    return np.maximum(total - _MARGIN, 0)


def score(data: np.ndarray, offsets: np.ndarray, model: Model, bits: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row."""
    spans = W.spans(data, offsets)
    found = word_features(data, spans)
    own = word_scores(found, model, bits)
    some = np.flatnonzero(own > 0)
    logit = np.full(len(offsets) - 1, model.bias)
    if len(some):
        rows, own = spans.rows[some], own[some]
        order = np.lexsort((-own, rows))
        rows, own = rows[order], own[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        np.add.at(logit, rows[rank < TOP], own[rank < TOP])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(
    rows: list[tuple[str, int]],
    identity: list[str] | tuple[str, ...] = tuple(IDENTITY),
    penalty: float = PENALTY,
    epochs: int = EPOCHS,
    seed: int = 5,
) -> Model:
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, _U), np.zeros(0), -30.0)
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in [*(text for text, _ in rows), " ".join(identity)]]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    # Distinct words with their features, and the words of each text; in passes, so that no array is as long as all texts.
    docs: list[np.ndarray] = []
    known = []
    for start, stop in passes(offsets):
        own = offsets[start : stop + 1]
        part = data[own[0] : own[-1]]
        spans = W.spans(part, own - own[0])
        found = word_features(part, spans)
        known.append(found[:, np.unique(found[0], return_index=True)[1]])
        cuts = np.concatenate(([0], np.cumsum(spans.counts)))
        docs += [found[0, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:])]
    table = np.concatenate(known, axis=1)
    names, first = np.unique(table[0], return_index=True)
    keys, feature = np.unique(table[:, first], return_inverse=True)
    feature = feature.reshape(len(table), len(names))
    docs = [np.searchsorted(names, doc) for doc in docs]
    terms = np.unique(docs.pop())

    held = np.zeros((2, len(keys)))
    for doc, label in zip(docs, labels):
        held[label][np.unique(feature[:, np.unique(doc)])] += 1
    n = np.bincount(labels, minlength=2)
    theta = np.log((held[1] + _SMOOTH) / (n[1] + _SMOOTH)) - np.log((held[0] + _SMOOTH) / (n[0] + _SMOOTH))
    # What few texts of label 1 hold, or as many others, says nothing: such features stay at 0, and words without any
    # other feature need no training. Those of identity terms always take part.
    usable = (held[1] >= LEAST_TEXTS) & (theta > LEAST_ODDS)
    usable[feature[:, terms].ravel()] = True
    usable[keys == 0] = False
    theta[~usable] = 0
    useful = usable[feature].any(axis=0)
    docs = [doc[useful[doc]] for doc in docs]
    bias, balance = -3.0, len(labels) / (2 * n)
    seen, seen_bias = np.full(len(keys), 1e-6), 1e-6

    def top(doc: np.ndarray) -> tuple[np.ndarray, float]:
        own = theta[feature[:, doc]].sum(axis=0) - _MARGIN
        best = np.argsort(-own, kind="stable")[:TOP]
        best = best[own[best] > 0]
        return doc[best], bias + own[best].sum()

    def step(parts: list[tuple[np.ndarray, float]], of_bias: float) -> None:
        nonlocal bias, seen_bias
        grad: dict[int, float] = {}
        for chosen, slope in parts:
            for f in feature[:, chosen].ravel().tolist():
                if usable[f]:
                    grad[f] = grad.get(f, 0.0) + slope
        if grad:
            at, g = np.fromiter(grad, np.int64), np.fromiter(grad.values(), float)
            g = g + 1e-4 * theta[at]
            seen[at] += g * g
            theta[at] -= RATE * g / np.sqrt(seen[at])
        if of_bias:
            seen_bias += of_bias**2
            bias -= RATE * of_bias / np.sqrt(seen_bias)

    named = set(terms.tolist())
    for _ in range(epochs):
        for k in rng.permutation(len(docs)).tolist():
            doc = docs[k]
            chosen, logit = top(doc)
            slope = (1 / (1 + np.exp(-logit)) - labels[k]) * balance[labels[k]]
            step([(chosen, slope)], slope)
            if penalty and len(terms) > 1:
                own = [w for w in doc.tolist() if w in named]
                plain = np.array([w for w in doc.tolist() if w not in named], np.int64)
                other = rng.choice(terms, max(1, len(own)))
                one = np.concatenate((plain, own or rng.choice(terms, 1))).astype(np.int64)
                two = np.concatenate((plain, other)).astype(np.int64)
                (a, za), (b, zb) = top(one), top(two)
                change = 2 * penalty * np.clip(za - zb, -3, 3)
                if change:
                    step([(a, change), (b, -change)], 0.0)
    keep = np.flatnonzero((np.abs(theta) > 0.05) & usable)
    return Model(keys[keep], theta[keep], float(bias))


def classify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = Model(*shared.value)
        bits = _filter(own_model.keys)
        for batch in batches:
            for start, stop, data, offsets in text_passes(batch.column(batch.num_columns - 1)):
                found = score(data, offsets, own_model, bits)
                own = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(found), pa.array(found >= 0.5).cast(pa.int32())],
                    names=[*batch.schema.names[:-1], "score", "predicted"],
                )

    return rows.mapInArrow(run, f"{kept}, score DOUBLE, predicted INT")
