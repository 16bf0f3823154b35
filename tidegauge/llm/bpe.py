"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokens are those of the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
found without a regular expression. A code point becomes a symbol (its class, with what the pattern looks ahead for);
a symbol is a function on the states of a small automaton. Functions compose associatively and only some dozens are ever
made, so a scan over their numbers in one table gives the state before every code point, for all texts of a pass at once.

Slices between boundaries are looked up in a cache of bounded size. Unknown ones are merged together: each round joins
the leftmost pair of lowest rank in every piece. Long pieces go through a heap instead. Ids come with the byte offset of
each token, and decoding joins the bytes of the ids.

Defined cases: null is the empty text, which has no tokens. Repeated rows are encoded each. Texts of any length are
taken whole. Extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import text_passes
from tidegauge.llm.words import LETTERS, span_hashes

CACHE_ENTRIES = 400_000
#: Pieces of more bytes are merged with a heap, one by one.
LONG_PIECE = 128

LETTER, NUMBER, SPACE, BLANK, OTHER = range(5)
_SCAN_ROWS = 512
_NO_RANK = np.iinfo(np.int32).max

# States: what the token in progress is. E: a blank that ends its token, S: a space that the next token may take,
# C1 and C2: letters of a contraction to come, X: a contraction just ended.
_L, _N, _O, _W, _E, _S, _C1, _C2, _X = range(9)
# Symbols. WMID: white space with more after it or at the end of a text; WLAST and SLAST: the last before something else,
# SLAST if it is U+0020; A1 and A2: an apostrophe that one or two letters follow as in the pattern.
_SYM_L, _SYM_N, _SYM_O, _SYM_A1, _SYM_A2, _SYM_WMID, _SYM_WLAST, _SYM_SLAST = range(8)
_FRESH = 8  # added for the first code point of a text


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a code point, and whether a token starts with it."""
    if symbol == _SYM_L:
        if state in (_C1, _C2):
            return (_X, _C1)[state - _C1], False
        return _L, state not in (_L, _S)
    if symbol == _SYM_N:
        return _N, state not in (_N, _S)
    if symbol in (_SYM_O, _SYM_A1, _SYM_A2):
        if state in (_O, _S):
            return _O, False
        return (_O, _C1, _C2)[symbol - _SYM_O], True
    if symbol == _SYM_WMID:
        return _W, state != _W
    return (_E, _S)[symbol - _SYM_WLAST], True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols' functions, the composition table, states by function, and token starts."""
    plain = [tuple(_step(q, s)[0] for q in range(9)) for s in range(8)]
    fresh = [(_step(_X, s)[0],) * 9 for s in range(8)]
    known: dict[tuple, int] = {}
    todo = [tuple(range(9)), *plain, *fresh]
    while todo:
        f = todo.pop()
        if f not in known:
            known[f] = len(known)
            todo.extend(tuple(g[q] for q in f) for g in plain + fresh)
    functions = list(known)
    table = np.array([[known[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint16)
    starts = np.array([[_step(q, s)[1] for s in range(8)] + [True] * 8 for q in range(9)])
    return np.array([known[f] for f in plain + fresh], np.uint16), table, np.array([f[0] for f in functions], np.uint8), starts


_NUMBER_OF, _COMPOSE, _STATE_OF, _STARTS = _monoid()
_IDENTITY = next(k for k in range(len(_COMPOSE)) if (_COMPOSE[k] == np.arange(len(_COMPOSE))).all())


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = LETTER if kind == "L" else NUMBER
    # The code points with the White_Space property.
    for low, high in (
        (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
        (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ):
        table[low : high + 1] = BLANK
    table[0x20] = SPACE
    # Letters and numbers of Unicode 16, which the tokenizer library knows and older Pythons do not.
    for low, high in (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
        (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
        (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
        (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ):
        table[low : high + 1] = LETTER
    for low, high in (
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
        (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
    ):
        table[low : high + 1] = NUMBER
    return table


def _scan(numbers: np.ndarray) -> np.ndarray:
    """The state before each position: an exclusive scan of function compositions, in blocks."""
    n = len(numbers)
    rows = min(_SCAN_ROWS, max(1, n))
    blocks = -(-n // rows)
    padded = np.full(rows * blocks, _IDENTITY, np.uint16)
    padded[:n] = numbers
    columns = np.ascontiguousarray(padded.reshape(blocks, rows).T)
    flat, width = _COMPOSE.ravel(), np.uint32(len(_COMPOSE))
    inside = np.empty_like(columns)
    inside[0] = columns[0]
    for k in range(1, rows):
        inside[k] = flat[inside[k - 1] * width + columns[k]]
    total, reach = inside[-1].copy(), 1
    while reach < blocks:
        total[reach:] = flat[total[:-reach] * width + total[reach:]]
        reach *= 2
    before = np.concatenate(([_IDENTITY], total[:-1])).astype(np.uint16)
    exclusive = np.empty_like(columns)
    exclusive[0] = before
    exclusive[1:] = flat[before[None, :] * width + inside[:-1]]
    return _STATE_OF[np.ascontiguousarray(exclusive.T).ravel()[:n]]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts; ``firsts`` are the first positions of the texts that are not empty."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    fresh = np.zeros(n + 4, bool)
    fresh[firsts] = True
    fresh[n:] = True
    white = np.zeros(n + 1, bool)
    white[:n] = (kind == SPACE) | (kind == BLANK)
    last = white[:n] & ~white[1:] & ~fresh[1 : n + 1]
    symbol = np.array([_SYM_L, _SYM_N, _SYM_WMID, _SYM_WMID, _SYM_O], np.uint8)[kind]
    symbol[last] = np.where(kind[last] == SPACE, _SYM_SLAST, _SYM_WLAST)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        ahead = np.concatenate((points, np.zeros(3, points.dtype)))
        one, two = ahead[marks + 1], ahead[marks + 2]
        single = np.isin(one, [0x73, 0x74, 0x6D, 0x64]) & ~fresh[marks + 1]
        double = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        double &= ~fresh[marks + 1] & ~fresh[marks + 2]
        symbol[marks[single]], symbol[marks[double]] = _SYM_A1, _SYM_A2
    symbol[firsts] += _FRESH
    return np.flatnonzero(_STARTS[_scan(_NUMBER_OF[symbol]), symbol])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[k] .. starts[k] + sizes[k] - 1`` of all k, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Cache:
    """Ids of pieces by 64-bit hash, an open table of array lookups; bounded: rarely used pieces go before a pass that
    finds it full. The table grows with the pieces of a pass, so that at least half of it is free."""

    #: Size of an empty table.
    BITS = 21

    def __init__(self, bound: int):
        self.bound = bound
        self._empty()

    def _empty(self) -> None:
        self.bits = self.BITS
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it is unknown."""
        found = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), self._home(hashes)
        while len(left):
            entry = self.slots[slot]
            left, slot, entry = (x[entry >= 0] for x in (left, slot, entry))
            hit = self.hashes[entry] == hashes[left]
            found[left[hit]] = entry[hit]
            left, slot = left[~hit], (slot[~hit] + 1) & (len(self.slots) - 1)
        return found

    def add(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """New distinct pieces."""
        first = len(self.hashes)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.hashes, self.sizes = np.concatenate((self.hashes, hashes)), np.concatenate((self.sizes, sizes))
        self.starts, self.flat = np.concatenate((self.starts, starts)), np.concatenate((self.flat, flat))
        self.uses = np.concatenate((self.uses, np.zeros(len(hashes), np.int64)))
        if 2 * len(self.hashes) > len(self.slots):
            self.bits = (2 * len(self.hashes) - 1).bit_length()
            self.slots = np.full(1 << self.bits, -1, np.int64)
            first = 0
        entry, slot = np.arange(first, len(self.hashes)), self._home(self.hashes[first:])
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]  # of several, one stays
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (len(self.slots) - 1)

    def shrink(self) -> None:
        """Make room before a pass: half the bound at most stays, what was used most."""
        if len(self.hashes) < self.bound:
            return
        order = np.sort(np.argsort(-self.uses, kind="stable")[: self.bound // 2])
        hashes, sizes, uses = self.hashes[order], self.sizes[order], self.uses[order]
        flat = self.flat[ragged(self.starts[order], sizes)]
        self._empty()
        self.add(hashes, sizes, flat)
        self.uses = uses // 2


class Encoder:
    """Ranks, a pair table made from them, and the cache of pieces. Made once per Python worker."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        names = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            names[rank] = token
        self.token_sizes = np.array([len(t) for t in names])
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(names), np.uint8)
        digits = [b"%d " % k for k in range(len(names))]
        self.digit_sizes = np.array([len(d) for d in digits])
        self.digit_starts = np.cumsum(self.digit_sizes) - self.digit_sizes
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        # Most lookups fail: a bit table answers those with one read.
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.keys)] = True
        self.cache = Cache(CACHE_ENTRIES)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x2545F4914F6CDD1D)) >> np.int64(42)) & np.int64((1 << 22) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, a large number if it is none."""
        keys = left << 20 | right
        found = np.full(len(keys), _NO_RANK, np.int64)
        some = np.flatnonzero(self.maybe[self._slot(keys)])
        at = np.searchsorted(self.keys, keys[some])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[some]
        found[some[hit]] = self.merged[at[hit]]
        return found

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids, and ids, of many short pieces. Pieces of equal length are columns of one table and advance
        together, longest first: a merge makes them one shorter, and they join the next table."""
        lengths = np.array([len(p) for p in pieces])
        sizes, ended = np.zeros(len(pieces), np.int64), []
        ids, ranks, owner = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
        for width in range(int(lengths.max(initial=0)), 0, -1):
            new = np.flatnonzero(lengths == width)
            if len(new):
                data = np.frombuffer(b"".join([pieces[k] for k in new.tolist()]), np.uint8)
                table = np.ascontiguousarray(self.byte_rank[data].reshape(len(new), width).T)
                pairs = self.pair_ranks(table[:-1].ravel(), table[1:].ravel()).reshape(width - 1, len(new))
                if len(owner):
                    table, pairs = np.concatenate((ids, table), axis=1), np.concatenate((ranks, pairs), axis=1)
                    new = np.concatenate((owner, new))
                ids, ranks, owner = table, pairs, new
            if not len(owner):
                continue
            place = np.arange(width - 1)[:, None]
            best = (ranks << 8 | place).min(axis=0) if width > 1 else np.full(len(owner), _NO_RANK << 8)
            ready = best >> 8 == _NO_RANK
            if ready.any():
                sizes[owner[ready]] = width
                ended.append((owner[ready], ids[:, ready].T))
                go = ~ready
                ids, ranks, owner, best = ids[:, go], ranks[:, go], owner[go], best[go]
            if not len(owner):
                ids, ranks = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64)
                continue
            at, column = best & 255, np.arange(len(owner))
            ids[at, column] = best >> 8
            ids = np.where(place <= at, ids[:-1], ids[1:])
            # the rank at a pair's left end goes with the symbol that went
            ranks = np.where(place[:-1] < at, ranks[:-1], ranks[1:])
            some = np.flatnonzero(at < width - 2)
            ranks[at[some], some] = self.pair_ranks(ids[at[some], some], ids[at[some] + 1, some])
            some = np.flatnonzero(at > 0)
            ranks[at[some] - 1, some] = self.pair_ranks(ids[at[some] - 1, some], ids[at[some], some])
        flat, starts = np.zeros(int(sizes.sum()), np.int64), np.cumsum(sizes) - sizes
        for owners, table in ended:
            flat[starts[owners][:, None] + np.arange(table.shape[1])] = table
        return sizes, flat

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one long piece: a heap of pairs over a linked list."""
        ids = [int(self.byte_rank[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        parts: list[bytes | None] = [bytes([b]) for b in piece]
        heap: list[tuple[int, int, bytes, bytes]] = []

        def push(k: int) -> None:
            j = after[k]
            if j < len(ids) and (rank := self.ranks.get(parts[k] + parts[j])) is not None:
                heapq.heappush(heap, (rank, k, parts[k], parts[j]))

        for k in range(len(ids) - 1):
            push(k)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            if parts[k] != a or (j := after[k]) >= len(ids) or parts[j] != b:
                continue
            parts[k], parts[j], ids[k] = a + b, None, rank
            after[k] = after[j]
            if after[k] < len(ids):
                before[after[k]] = k
            push(k)
            if before[k] >= 0:
                push(before[k])
        return tuple(x for x, part in zip(ids, parts) if part is not None)

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids, and ids, of distinct pieces."""
        whole = [self.ranks.get(p) for p in pieces]
        sizes = np.ones(len(pieces), np.int64)
        rest = [k for k, rank in enumerate(whole) if rank is None]
        short = [k for k in rest if len(pieces[k]) <= LONG_PIECE]
        own, merged = self.merge([pieces[k] for k in short])
        long = {k: self.merge_long(pieces[k]) for k in rest if len(pieces[k]) > LONG_PIECE}
        sizes[short] = own
        for k, ids in long.items():
            sizes[k] = len(ids)
        flat, starts = np.zeros(int(sizes.sum()), np.int64), np.cumsum(sizes) - sizes
        one = [k for k, rank in enumerate(whole) if rank is not None]
        flat[starts[one]] = [whole[k] for k in one]
        flat[ragged(starts[short], own)] = merged
        for k, ids in long.items():
            flat[starts[k] : starts[k] + len(ids)] = ids
        return sizes, flat

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a pass, and where each text's ids begin, with the end; ``offsets`` are byte positions."""
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte position of each code point
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        some = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts = at[boundaries(points, np.searchsorted(at, some))]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = span_hashes(LETTERS[raw], starts, ends)
        cache = self.cache
        cache.shrink()
        number = cache.find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            pieces = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
            cache.add(new, *self.ids_of(pieces))
            number[missing] = cache.find(hashes[missing])
        cache.uses += np.bincount(number, minlength=len(cache.uses))
        sizes = cache.sizes[number]
        ids = cache.flat[ragged(cache.starts[number], sizes)]
        of_piece = np.concatenate(([0], np.cumsum(sizes)))
        if self.decode(ids) != data:  # two pieces with one hash: once in some 10**12 pieces
            cache._empty()
            sizes, ids = self.ids_of([data[i:j] for i, j in zip(starts.tolist(), ends.tolist())])
            of_piece = np.concatenate(([0], np.cumsum(sizes)))
        return ids, of_piece[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged(self.token_starts[ids], self.token_sizes[ids])].tobytes()

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids, a space after each."""
        return self.digit_bytes[ragged(self.digit_starts[ids], self.digit_sizes[ids])].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token, and the end: ids ``a`` to ``b`` are the bytes from ``offsets[a]`` to ``offsets[b]``."""
        return np.concatenate(([0], np.cumsum(self.token_sizes[ids])))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_tokens: bool = False) -> DataFrame:
    """``keep`` columns with ``n_tokens, ids_sha256, decoded_sha256``.

    ``path`` names the rank file, present on every executor. ``with_tokens`` adds ``ids`` and ``offsets``: tokens, and the
    byte offset of each with the end of the text.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    fields = "n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING"
    fields += ", ids ARRAY<INT>, offsets ARRAY<LONG>" * with_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for start, stop, data, offsets in text_passes(batch.column(batch.num_columns - 1)):
                ids, cuts = tool.encode(data.tobytes(), offsets)
                decoded, digits = tool.decode(ids), tool.digits(ids)
                of_bytes = np.concatenate(([0], np.cumsum(tool.token_sizes[ids])))[cuts].tolist()
                of_digits = np.concatenate(([0], np.cumsum(tool.digit_sizes[ids])))[cuts].tolist()
                sha = lambda x: hashlib.sha256(x).hexdigest()
                columns = [
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array([sha(digits[a : max(a, b - 1)]) for a, b in zip(of_digits, of_digits[1:])], pa.string()),
                    pa.array([sha(decoded[a:b]) for a, b in zip(of_bytes, of_bytes[1:])], pa.string()),
                ]
                if with_tokens:
                    lists = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                    columns.append(pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())))
                    columns.append(pa.array([tool.offsets(x) for x in lists], pa.list_(pa.int64())))
                own = batch.slice(start, stop - start)
                names = [*batch.schema.names[:-1], *(x.split()[0] for x in fields.split(", "))]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *columns], names=names)

    return rows.mapInArrow(run, f"{kept}, {fields}")
