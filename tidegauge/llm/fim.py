"""Fill-in-middle transformation: a document's lines are cut at two ranks, its parts reordered round sentinels.

The lines of a document form an indexable skip list. The base lane has one link a line; a link of an express lane leads
over ``FAN`` links of the lane below. Every link carries two widths, the lines and the code points it passes. A rank is
reached from the top: follow a lane while the widths add up to at most the rank, then go down one lane. The code points
passed on the way are the place of the cut, so both cuts are exact after some ``FAN * log(n)`` links, whatever the
length of the lines.

A line is ``[^\\n]*\\n|[^\\n]+``. With h1 to h4 the first four groups of 8 digits of ``sha256("<seed>:<doc_id>")`` in hex
and n the number of lines, the prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` lines, the middle
after the larger. The form is ``plain`` if the text is empty, holds a sentinel, or ``h3 % 100 >= rate``; otherwise
``spm`` if ``h4 % 100 < spm``, else ``psm``:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle

``restore`` takes the parts back out of an output. A part cannot hold a sentinel, nor can one arise where a part meets a
sentinel, so the first occurrence of each is the real one.

Defined cases: null is the empty text, which has no lines and stays plain. A null id is written as the empty text. Rows
that repeat are transformed each. Texts are taken whole; one text is the unit of memory. Extra columns are dropped unless
named in ``keep``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import text_passes

SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
FAN = 8


class SkipList:
    """Units of given code-point widths; finds the code points before a unit."""

    def __init__(self, points: np.ndarray):
        self.units = len(points)
        #: Lanes from the base up: lines passed by each link, code points passed by each link.
        self.lanes = [(np.ones(len(points), np.int64), points)]
        while len(points) > FAN:
            below = self.lanes[-1]
            first = np.arange(0, len(points), FAN)
            self.lanes.append(tuple(np.add.reduceat(width, first) for width in below))
            points = self.lanes[-1][1]

    def before(self, rank: int) -> int:
        """Code points before unit ``rank``; all of them for ``rank = units``."""
        link = passed = place = 0
        for units, points in reversed(self.lanes):
            while link < len(units) and passed + units[link] <= rank:
                passed += int(units[link])
                place += int(points[link])
                link += 1
            link *= FAN  # the same place on the lane below
        return place


def line_widths(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every line of all texts of a pass, and where each text's lines begin, with the end."""
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = data == 10
    ends[offsets] = True  # a text also ends its last line; an empty text adds nothing
    starts = np.flatnonzero(ends[:-1])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    widths = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), starts)
    return widths, np.searchsorted(starts, offsets)


def draws(seed: int, doc_id: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(text: str, widths: np.ndarray, drawn: list[int], rate: int, spm: int) -> tuple[str, int, int]:
    """Form, and the code points before the middle and before the suffix."""
    if not text or any(s in text for s in SENTINELS) or drawn[2] % 100 >= rate:
        return "plain", 0, 0
    lines = SkipList(widths)
    low, high = sorted((drawn[0] % (lines.units + 1), drawn[1] % (lines.units + 1)))
    return "spm" if drawn[3] % 100 < spm else "psm", lines.before(low), lines.before(high)


def arrange(text: str, form: str, first: int, second: int) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restore(output: str, form: str) -> str:
    """The text that ``arrange`` was given."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def transform(
    docs: DataFrame,
    seed: int = SEED,
    rate: int = RATE,
    spm: int = SPM,
    keep: tuple[str, ...] = ("doc_id",),
    with_output: bool = True,
) -> DataFrame:
    """``keep`` columns with ``n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` and ``output``.

    ``rate`` is the percentage of documents transformed, ``spm`` that of suffix-first ones among them.
    """
    rows = docs.select(
        *keep,
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__key"),
        F.col("text").cast("string").alias("__text"),
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    fields = "n LONG, form STRING, prefix_chars LONG, middle_chars LONG, output_sha256 STRING, restored_sha256 STRING"
    fields += ", output STRING" * with_output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            keys, texts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for start, stop, data, offsets in text_passes(texts):
                widths, cuts = line_widths(data, offsets)
                found = []
                for row in range(start, stop):
                    text, own = texts[row].as_py() or "", widths[cuts[row - start] : cuts[row - start + 1]]
                    form, first, second = cut(text, own, draws(seed, keys[row].as_py()), rate, spm)
                    output = arrange(text, form, first, second)
                    sizes = (None, None) if form == "plain" else (first, second - first)
                    found.append((len(own), form, *sizes, sha(output), sha(restore(output, form)), output)[: 6 + with_output])
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                own = batch.slice(start, stop - start)
                names = [*batch.schema.names[:-2], *(x.split()[0] for x in fields.split(", "))]
                yield pa.RecordBatch.from_arrays([*own.columns[:-2], *columns], names=names)

    return rows.mapInArrow(run, f"{kept}, {fields}")
