"""Token counts by a tokenizer library, with overlap resynchronisation for huge documents.

A document of more than ``chunk`` code points is never encoded at once. Chunks are encoded with offsets; each overlaps the
one before. Inside the overlap a place is sought where both encodings have a token boundary that is proven stable; the
left chunk counts up to there, the right one from there. If the overlap has no such place it is widened fourfold, up to
the whole left chunk, and then the left chunk itself grows: in the end the rest of the document is one chunk.

Proof of stability, from the rules of the tokenizer file, which are read and compared with ``RULES`` first. A boundary is
stable behind a blank (space, tab, line ends) and before or behind an ASCII digit:
- no added token holds a blank or a digit, and none takes blanks at its sides;
- composition (NFC) never joins a blank or an ASCII digit with what comes before it; marks behind them stay behind them;
- the other normalisers map single code points or runs of blanks;
- pieces of the pattern hold no blanks, and a number is always a piece of its own, whatever stands beside it; a piece
  depends only on text from its own start, and its look-ahead (two letters behind an apostrophe) ends at both.
So the text behind such a place is encoded alike with and without the text before it, and the other way round. Files
with other rules have no proof: their documents are encoded whole.

Shorter documents are counted by their pieces between spaces and line feeds, which are stable boundaries too; pieces
that repeat in a batch are encoded once, and a bounded cache keeps them for later batches.

Defined cases: null is the empty text: no bytes, no tokens. Repeated rows are counted each. Special strings inside a text
are what the library makes of them by default. Extra columns are dropped unless named in ``keep``. An empty table gives
an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import text_passes

#: Code points of a chunk, and of its first overlap with the next one.
CHUNK, OVERLAP = 1 << 16, 256
#: Tokens above which a document is over the limit.
LIMIT = 2048
CACHE_PIECES, LONGEST_CACHED = 500_000, 64
# The rules of the file that the proof above holds for.
RULES = {
    "normalizer": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
#: A place behind a blank, or before or behind a digit.
_STABLE = re.compile(r"(?<=[ \t\n\r0-9])(?=.)|(?=[0-9])", re.S)
_HARD = re.compile(r"[ \t\n\r0-9]")


def proven(rules: dict) -> bool:
    """Whether the proof holds for a tokenizer file."""
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (rules.get("normalizer") or {}).get("normalizers") == RULES["normalizer"]
        and steps[0].get("type") == "Split"
        and steps[0].get("pattern") == {"Regex": RULES["pattern"]}
        and steps[0].get("behavior") == "Removed"
        and bool(steps[0].get("invert"))
        and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
        and not rules.get("truncation")
        and not rules.get("padding")
        and not any(t["lstrip"] or t["rstrip"] or _HARD.search(t["content"]) for t in rules.get("added_tokens") or [])
    )


class Counter:
    """The library's tokenizer and a bounded cache of piece counts. Made once per Python worker."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.proven = proven(json.load(file))
        self.tool = Tokenizer.from_file(path)
        self.bound, self.known = cache_pieces, {}

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token, in code points."""
        found = self.tool.encode(text, add_special_tokens=False).offsets
        table = np.array(found, np.int64).reshape(-1, 2)
        return table[:, 0], table[:, 1]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def short(self, texts: list[str]) -> list[int]:
        """Tokens of each text, by distinct pieces."""
        if not self.proven:
            return self.whole(texts)
        rows = [text.replace("\n", " ").split(" ") for text in texts]
        new = [piece for piece in set().union(*rows) if piece not in self.known]
        self.known.update(zip(new, self.whole(new)))
        found = [sum(map(self.known.__getitem__, row)) for row in rows]
        for piece in new:
            if len(piece) > LONGEST_CACHED:
                del self.known[piece]
        if len(self.known) > self.bound:
            self.known = {}
        return found

    def long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text of any length, chunk by chunk."""
        if not self.proven or len(text) <= chunk:
            return self.whole([text])[0]
        total, base, begin, end = 0, 0, 0, chunk  # chunk [base, end), counted from begin on
        starts, ends = self.spans(text[:end])
        while end < len(text):
            width, place = overlap, None
            while place is None:
                first = max(begin, end - width)
                after = min(len(text), end + chunk)
                next_starts, next_ends = (x + first for x in self.spans(text[first:after]))
                place = splice(text, first, end, (starts, ends), (next_starts, next_ends))
                if place is None and first == begin:
                    break
                width *= 4
            if place is None:  # no stable place in the whole chunk: it grows to twice its length
                end = min(len(text), begin + 2 * (end - begin))
                base = begin
                starts, ends = (x + base for x in self.spans(text[base:end]))
                continue
            total += int(np.searchsorted(starts, place) - np.searchsorted(starts, begin))
            base, begin, end, starts, ends = first, place, after, next_starts, next_ends
        return total + len(starts) - int(np.searchsorted(starts, begin))


def splice(
    text: str, first: int, end: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]
) -> int | None:
    """The last stable place between ``first`` and ``end`` where a token of both encodings starts and none reaches over."""
    places = np.array([m.start() + first for m in _STABLE.finditer(text[first:end])], np.int64)
    places = places[(places > first) & (places < end)]
    for starts, ends in (left, right):
        at = np.searchsorted(starts, places)
        inside = at < len(starts)
        places, at = places[inside], at[inside]
        reach = np.concatenate(([0], np.maximum.accumulate(ends)))
        places = places[(starts[at] == places) & (reach[at] <= places)]
    return int(places[-1]) if len(places) else None


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep`` columns with ``n_bytes, n_tokens, over_limit``. ``path`` names the tokenizer file on every executor."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [*rows.columns[:-1], "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            for start, stop, data, offsets in text_passes(batch.column(batch.num_columns - 1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                tokens = np.zeros(len(texts), np.int64)
                small = [k for k, text in enumerate(texts) if len(text) <= chunk]
                tokens[small] = tool.short([texts[k] for k in small])
                for k, text in enumerate(texts):
                    if len(text) > chunk:
                        tokens[k] = tool.long(text, chunk, overlap)
                own = batch.slice(start, stop - start)
                columns = [pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *columns], names=names)

    return rows.mapInArrow(run, f"{kept}, n_bytes LONG, n_tokens LONG, over_limit BOOLEAN")
