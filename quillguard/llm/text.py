"""Words of Arrow text columns as numpy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once; one longer text is taken alone.
PIECE_BYTES = 1 << 20

#: The bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _random_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


_BYTES = _random_table(20240611)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    out = _POWERS[0][:n], _POWERS[1][:n]
    if n > 4 * PIECE_BYTES:  # of one very long text; not kept
        _POWERS[:] = [x[:PIECE_BYTES].copy() for x in _POWERS]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most PIECE_BYTES of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        end, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = end[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(end, done + PIECE_BYTES, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def small(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few, for work on Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    return data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


class Words:
    """starts, ends: of each word in data; bounds: the first word of each row, and the number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inner = np.zeros(len(data) + 2, bool)
        inner[1:-1] = ~separators[data]
        first = inner[1:-1] & ~inner[:-2]
        last = inner[1:-1] & ~inner[2:]
        edges = offsets[1:-1]
        at = edges[(edges > 0) & (edges < len(data))]  # no word goes over the end of a row
        first[at] = inner[1:-1][at]
        last[at - 1] = inner[1:-1][at - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.data):
            return np.zeros(0, U)
        power, inverse = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(_BYTES[self.data] * power, out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span of data."""
    if not len(data):
        return np.full(len(starts), mix(np.zeros(1, U))[0], U)
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * power, out=sums[1:])
    at = np.minimum(starts, len(data) - 1)
    return mix((sums[ends] - sums[starts]) * inverse[at] + (ends - starts).astype(U))


def windows_hash(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k of the words' hashes; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n]
    for j in range(1, k):
        out = mix(out + U(j)) + words[j : j + n]
    return mix(out)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence, as an array of one; empty for no words."""
    out = np.zeros(0, U)
    if len(words):
        out = words[:1]
        for j in range(1, len(words)):
            out = mix(out + U(j)) + words[j : j + 1]
        out = mix(out ^ U(len(words)))
    return out


def runs_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of word hashes, starts up to ends."""
    if not len(hashes):
        return np.full(len(starts), mix(np.zeros(1, U))[0], U)
    power, inverse = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * power, out=sums[1:])
    at = np.minimum(starts, len(hashes) - 1)
    return mix((sums[ends] - sums[starts]) * inverse[at] + (ends - starts).astype(U))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of all rows, the empty ones too, and each line's row."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    row = np.concatenate([np.arange(len(offsets) - 1), rows])
    # a line's start pairs with the next end in the same row
    a, b = np.lexsort((starts, row)), np.lexsort((ends, row))
    return starts[a], ends[b], row[a]
