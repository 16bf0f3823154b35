"""Words of byte texts, and 64-bit hashes of words and word windows, as array operations.

A word is a longest run of ``0-9``, ``a-z`` and bytes from 0x80 on, after ``A-Z`` are lower-cased: the UTF-8 form of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LETTERS = np.random.default_rng(20240607).integers(1, 2**63, 256).astype(_U)
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, kept and grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (
                np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, b, _U)]) for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_POWERS, _WINDOW_POWERS = _Powers(_BASE), _Powers(_WINDOW_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _POWERS) -> np.ndarray:
    """Hash of each span of ``values``; equal contents at any place give equal hashes."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


class Words(NamedTuple):
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    rows: np.ndarray  # row of each word, ascending
    counts: np.ndarray  # words of each row


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD) -> Words:
    """Longest runs of bytes of a kind; none reaches from one row into the next."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    here = inside[1:-1]
    starts = np.flatnonzero(here & (~inside[:-2] | fresh[:-1]))
    ends = np.flatnonzero(here & (~inside[2:] | fresh[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return Words(starts, ends, rows, np.bincount(rows, minlength=len(offsets) - 1))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return span_hashes(LETTERS[LOWER[data]], words.starts, words.ends)


def window_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of ``size`` words inside one row."""
    last = len(hashes) - size + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    first = np.flatnonzero(rows[:last] == rows[size - 1 :])
    return first, span_hashes(hashes, first, first + size, _WINDOW_POWERS)


def row_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the windows of each row; a row of fewer words, but not none, has one window."""
    words = spans(data, offsets)
    hashes = word_hashes(data, words)
    first, windows = window_hashes(hashes, words.rows, size)
    cuts = np.searchsorted(words.rows[first], np.arange(len(offsets)))
    ends = np.cumsum(words.counts)
    found = []
    for row, count in enumerate(words.counts):
        if 0 < count < size:
            one = np.array([ends[row] - count]), np.array([ends[row]])
            found.append(span_hashes(hashes, *one, _WINDOW_POWERS))
        else:
            found.append(np.unique(windows[cuts[row] : cuts[row + 1]]))
    return found
