"""Benchmark decontamination by windows of normalised words.

The windows of all benchmark items form an index: sorted window hashes, each with the place of its words in the joined
text of the items. While the index stays under ``broadcast_bytes``, which is reckoned from the windows before anything is
collected, every task gets it: windows of the documents are hashed as arrays, a bit table refuses nearly all of them, the
sorted hashes confirm the rest, and the words themselves are compared last. A larger benchmark goes the other way, a
shuffle join on the window hash that also compares the words. Both ways give the same results, removed spans included.

Defined cases: null and empty texts have no words and are clean. An item without words never occurs. Items may share
windows, documents and items may repeat; each document row gives one result row. An item id that is null counts as the
empty string in the list of items. Texts of any length are taken whole; the hits of one text stay with that text. Extra
columns of the documents, whatever their names, are dropped unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.llm import words as W
from tidegauge.llm.common import scratch, stored, text_passes

WINDOW = 13
#: Largest index, in bytes, that is sent to every task; some 10 MB of benchmark text.
BROADCAST_BYTES = 64 << 20
#: Bytes of the index for one window: its hash, where it starts and ends, its item.
_WINDOW_BYTES = 32
_FILTER_BITS = 22
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATE = bytes(b if W.IS_WORD[b] else 32 for b in range(256))


def _normal(raw: np.ndarray) -> bytes:
    """The words of a text, lower-cased, with one blank between."""
    return b" ".join(bytes(W.LOWER[raw]).translate(_SEPARATE).split())


class Windows(NamedTuple):
    """Windows of one number of words; windows with equal words are one, those of equal hash stand side by side."""

    bits: np.ndarray  # whether some window has these last bits of a hash
    hashes: np.ndarray  # ascending
    starts: np.ndarray  # place of the words in the text of the index
    ends: np.ndarray
    cuts: np.ndarray  # window k has the items owners[cuts[k] : cuts[k + 1]]
    owners: np.ndarray


class Index:
    """Windows of the items by number of words; an item shorter than ``window`` is one window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        raw = [_normal(np.frombuffer(text, np.uint8)) for _, text in items]
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        own = np.array([number[name] for name, _ in items], np.int32)
        self.text = b"".join(raw)
        data, offsets = np.frombuffer(self.text, np.uint8), np.cumsum([0, *map(len, raw)])
        spans = W.spans(data, offsets)
        hashes = W.word_hashes(data, spans)
        wanted = np.minimum(spans.counts, window)
        self.sizes: dict[int, Windows] = {}
        for size in np.unique(wanted[wanted > 0]).tolist():
            first, found = W.window_hashes(hashes, spans.rows, size)
            mine = wanted[spans.rows[first]] == size
            first, found = first[mine], found[mine]
            order = np.argsort(found, kind="stable")
            first, found = first[order], found[order]
            starts, ends = spans.starts[first], spans.ends[first + size - 1]
            self.sizes[size] = self._grouped(found, starts, ends, own[spans.rows[first]])

    def _grouped(self, hashes, starts, ends, owners) -> Windows:
        """One window for equal words, with its distinct items."""
        leader, current = np.arange(len(hashes)), {}
        for k in np.flatnonzero(hashes[1:] == hashes[:-1]) + 1:
            if hashes[k - 1] != current.get("hash"):
                current = {"hash": hashes[k - 1], self.text[starts[k - 1] : ends[k - 1]]: k - 1}
            leader[k] = current.setdefault(self.text[starts[k] : ends[k]], k)
        pairs = np.unique(np.stack((leader, owners)), axis=1)
        heads, at = np.unique(pairs[0], return_index=True)
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return Windows(bits, hashes[heads], starts[heads], ends[heads], np.append(at, pairs.shape[1]), pairs[1].astype(np.int32))


def scan(data: np.ndarray, offsets: np.ndarray, index: Index):
    """Word spans, words hit, and for each row the names of the items whose windows occur."""
    spans = W.spans(data, offsets)
    hashes = W.word_hashes(data, spans)
    edge = np.zeros(len(hashes) + 1, np.int64)
    seen: dict[int, set[tuple[int, int]]] = {}
    for size, known in index.sizes.items():
        first, windows = W.window_hashes(hashes, spans.rows, size)
        maybe = np.flatnonzero(known.bits[(windows & np.uint64(len(known.bits) - 1)).astype(np.int64)])
        low, high = (np.searchsorted(known.hashes, windows[maybe], side) for side in ("left", "right"))
        some = np.flatnonzero(low < high)
        for start, a, b in zip(first[maybe[some]].tolist(), low[some].tolist(), high[some].tolist()):
            words = _normal(data[spans.starts[start] : spans.ends[start + size - 1]])
            for k in range(a, b):
                if words == index.text[known.starts[k] : known.ends[k]]:
                    edge[start] += 1
                    edge[start + size] -= 1
                    seen.setdefault(int(spans.rows[start]), set()).add((size, k))
    items: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    for row, windows in seen.items():
        owners = [index.sizes[size].owners[index.sizes[size].cuts[k] : index.sizes[size].cuts[k + 1]] for size, k in windows]
        items[row] = [index.names[n] for n in np.unique(np.concatenate(owners))]
    return spans, np.cumsum(edge[:-1]) > 0, items


def _without(data: np.ndarray, offsets: np.ndarray, spans: W.Words, hit: np.ndarray) -> list[str]:
    """Texts without the hit words and what stands between them."""
    texts = []
    ends = np.cumsum(spans.counts)
    for row, count in enumerate(spans.counts):
        own = slice(ends[row] - count, ends[row])
        start, stop = offsets[row], offsets[row + 1]
        text, flags = data[start:stop].tobytes(), hit[own]
        if flags.any():
            turn = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
            cuts = [(spans.starts[own][a] - start, spans.ends[own][b - 1] - start) for a, b in zip(turn[::2], turn[1::2])]
            kept, last = [], 0
            for a, b in cuts:
                kept.append(text[last:a])
                last = b
            text = b"".join([*kept, text[last:]])
        texts.append(text.decode())
    return texts


FIELDS = "n_words LONG, n_hit LONG, n_items LONG, items_sha256 STRING, contaminated BOOLEAN"


def _results(data, offsets, spans: W.Words, hit: np.ndarray, items: list[list[str]], cleaned: bool) -> list[pa.Array]:
    """The columns of ``FIELDS``, then the texts without spans; ``items`` are sorted."""
    n_hit = np.bincount(spans.rows[hit], minlength=len(offsets) - 1)
    columns = [
        pa.array(spans.counts, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        pa.array((n_hit > 0) & (20 * n_hit >= spans.counts)),
    ]
    return columns + ([pa.array(_without(data, offsets, spans, hit), pa.string())] if cleaned else [])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keep: tuple[str, ...] = ("doc_id",),
    cleaned: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    root: str | None = None,
) -> DataFrame:
    """``keep`` columns with ``n_words, n_hit, n_items, items_sha256, contaminated``; ``cleaned`` adds the text without spans.

    A document word inside any occurrence of an item window is hit; a document is contaminated from 5 % of hit words on.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = F.size(_words(F.col("text")))
    windows = F.when(words > 0, F.greatest(words - window + 1, F.lit(1))).otherwise(0)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + _WINDOW_BYTES * windows)).first()[0] or 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("text").cast("string").alias("text"))
    fields = FIELDS + ", cleaned STRING" * cleaned
    names = [x.split()[0] for x in fields.split(", ")]
    if size <= broadcast_bytes:
        index = Index([(r["item"], r["text"].encode()) for r in items.collect()], window)
        shared = docs.sparkSession.sparkContext.broadcast(index)
    else:
        rows = _hits_by_shuffle(rows, items, window, root or scratch(docs.sparkSession, "decontaminate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in text_passes(batch.column(1)):
                own = batch.slice(start, stop - start)
                if own.num_columns == 2:
                    found = scan(data, offsets, shared.value)
                else:
                    found = _marked(data, offsets, own.column(2), own.column(3))
                yield pa.RecordBatch.from_arrays([own.column(0), *_results(data, offsets, *found, cleaned)], names=["kept", *names])

    schema = T.StructType([rows.schema["kept"], *T.StructType.fromDDL(fields).fields])
    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], *names)


def _words(text: Column) -> Column:
    return F.filter(
        F.split(F.translate(text, _A_Z, _a_z), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""
    )


def _marked(data: np.ndarray, offsets: np.ndarray, hits: pa.Array, items: pa.Array):
    """As ``scan``, from the windows found before: ``hits`` of each row, first word and number of words."""
    spans = W.spans(data, offsets)
    before = np.cumsum(spans.counts) - spans.counts
    edge = np.zeros(len(spans.starts) + 1, np.int64)
    for row, own in enumerate(hits):
        if own.is_valid and len(own):
            at, size = (own.values.field(name).to_numpy() for name in ("at", "size"))
            np.add.at(edge, before[row] + at, 1)
            np.add.at(edge, before[row] + at + size, -1)
    return spans, np.cumsum(edge[:-1]) > 0, [x or [] for x in items.to_pylist()]


def _cut(words: Column, size: Column) -> Column:
    """All windows of ``size`` words: where each starts, and its hash."""
    last = F.size(words) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.struct(k.alias("at"), F.xxhash64(F.slice(words, k + 1, size)).alias("hash")))


def _key(words: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def _hits_by_shuffle(rows: DataFrame, items: DataFrame, window: int, root: str) -> DataFrame:
    """``rows`` with ``hits``, the windows of each text that occur in an item, and ``items``, the sorted ids of these.

    Only hashes and positions of windows are shuffled, against the distinct windows of the items, so that a passage in
    many items or documents meets one row on the other side. The windows that meet go back to their text, once for each
    text, and are compared word by word. Row numbers are written first: they must not change when a task is run again.
    """
    cut = items.select("item", _words(F.col("text")).alias("w")).where("size(w) > 0")
    cut = cut.withColumn("size", F.least(F.size("w"), F.lit(window)))
    named = F.transform(
        _cut(F.col("w"), F.col("size")),
        lambda x: F.struct(x["hash"].alias("hash"), _key(F.col("w"), x["at"], F.col("size")).alias("key")),
    )
    known = cut.select("item", "size", F.explode(named).alias("x")).select("item", "size", "x.hash", "x.key")
    known = stored(known.distinct(), root, "windows")
    distinct = known.select("size", "hash", "key").distinct()
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most `window` numbers
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), root, "rows")
    texts = rows.select("row", _words(F.coalesce("text", F.lit(""))).alias("w"))
    met = rows.sparkSession.createDataFrame([], "row LONG, at INT, size INT, key STRING")
    for size in sizes:
        spread = texts.select("row", F.explode(_cut(F.col("w"), F.lit(size))).alias("x")).select("row", "x.at", "x.hash")
        met = met.union(
            spread.join(distinct.where(F.col("size") == size), "hash").select("row", "at", "size", "key")
        )
    met = met.groupBy("row").agg(F.collect_list(F.struct("at", "size", "key")).alias("met"))
    true = F.filter("met", lambda x: _key(F.col("w"), x["at"], x["size"]) == x["key"])
    hits = stored(texts.join(met, "row").select("row", true.alias("hits")), root, "hits")
    of = hits.select("row", F.explode(F.array_distinct(F.transform("hits", lambda x: F.struct(x["size"], x["key"])))).alias("x"))
    of = of.select("row", "x.*").join(known.select("size", "key", "item"), ["size", "key"]).select("row", "item").distinct()
    of = of.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    places = F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"))).alias("hits")
    return rows.join(hits.select("row", places), "row", "left").join(of, "row", "left").select("kept", "text", "hits", "items")
