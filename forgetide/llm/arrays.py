"""Array arithmetic on the UTF-8 bytes of Arrow string columns.

Everything here is plain numpy over one Arrow batch. Words are maximal runs of
bytes that are no separators; a word's hash is a polynomial over its bytes, taken
from running sums, so that no Python loop touches single words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
STEPS = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1 for i in range(64)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * BASE)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]  # A-Z like a-z
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = True
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False

_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, factor in (("up", BASE), ("down", BASE_INVERSE)):
            row = np.full(size, factor, U64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def pieces(bounds: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, whose arrays stay in the cache and few in the worker; a longer text is a range of its own."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; `span_hash` reads the hash of any span from them."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(len(values) + 1)[0][:len(values)], dtype=U64, out=sums[1:])
    return sums


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    return prefix_sums(table[data])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(U64))


def even_spans(sums: np.ndarray, size: int) -> np.ndarray:
    """What `span_hash` gives for all spans of one size, in order."""
    count = max(len(sums) - size, 0)
    return mix((sums[size:] - sums[:count]) * _powers(len(sums))[1][:count] + U64(size))


class Words:
    """The words of some texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = BLANK,
                 table: np.ndarray = FOLDED):
        part = data[bounds[0]:bounds[-1]]
        local = bounds - bounds[0]
        inside = ~separators[part]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        edges = local[1:-1]
        edges = edges[(edges > 0) & (edges < len(part))]
        begin[edges] = inside[edges]
        finish[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.hash = span_hash(prefix_hash(part, table), self.start, self.end)
        self.first = np.searchsorted(self.start, local)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of runs of `size` words, the byte length of each, the first run of
        each text. A text of fewer words has all its words as one run."""
        n = len(self.hash)
        value, length = np.zeros(n, U64), np.zeros(n, np.int64)
        whole = max(n - size + 1, 0)
        for i in range(size):
            value[:whole] += self.hash[i:i + whole] * STEPS[i]
        length[:whole] = self.end[size - 1:size - 1 + whole] - self.start[:whole]
        words = np.diff(self.first)
        for row in np.flatnonzero((words > 0) & (words < size)):
            a, b = self.first[row], self.first[row + 1]
            value[a] = (self.hash[a:b] * STEPS[:b - a]).sum(dtype=U64) + U64(b - a)
            length[a] = self.end[b - 1] - self.start[a]
        runs = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
        first = np.concatenate([[0], np.cumsum(runs)])
        at = np.repeat(self.first[:-1] - first[:-1], runs) + np.arange(first[-1])
        return mix(value[at]), length[at], first


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """An array with these values in front and at least this size."""
    if size <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)])


class Memo(dict):
    """Chunk -> code, with the ids of every code in one pool. New chunks are encoded
    together by `flush`: `encode` gives all ids, the counts, and a mark for each chunk where marks are wanted. At `limit` chunks it starts anew, so its memory is bounded."""

    def __init__(self, encode, kind: str, limit: int = 1_000_000):
        super().__init__()
        self.encode, self.limit, self.kind = encode, limit, np.dtype(kind)
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new, self.pool, self.first, self.marked = [], np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(0, bool)
        self.used = self.known = 0

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        self.new.append(chunk)
        return code

    def codes(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))

    def flush(self) -> None:
        if self.new:
            ids, counts, *marks = self.encode(self.new)
            self.pool = _room(self.pool, self.used + len(ids))
            self.pool[self.used:self.used + len(ids)] = ids
            self.first = _room(self.first, self.known + len(counts) + 1)
            self.first[self.known + 1:self.known + len(counts) + 1] = self.used + np.cumsum(counts)
            if marks:
                self.marked = _room(self.marked, self.known + len(counts))
                self.marked[self.known:self.known + len(counts)] = marks[0]
            self.used, self.known, self.new = self.used + len(ids), self.known + len(counts), []

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these chunks one after the other, and how many each has."""
        self.flush()
        start = self.first[codes]
        count = self.first[codes + 1] - start
        return self.pool[gather(start, count)], count

    def trim(self) -> None:
        if len(self) > self.limit:
            self._empty()
