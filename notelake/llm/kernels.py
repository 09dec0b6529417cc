"""Array work on one Arrow batch of texts: words, rolling hashes, sliding minima.

Everything here runs inside a task on a slice of bounded size; no function keeps state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Stretches of more bytes are hashed one by one.
LONG_STRETCH = 96
# Texts are handled in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_BASE, WORD_BASE, WIDE_BASE = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F & ~2 | 5, 0x165667B19E3779F9 & ~2 | 5
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

# All ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = h + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 ... base**n modulo 2**64, and their inverses (the base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 20)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= SLICE_BYTES + 1:
            _powers[base] = have
    return have


class Rolling:
    """Hashes of any stretch ``values[a:b]`` in constant time each."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self._down = powers(base, n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self._sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self._sums[b] - self._sums[a]) * self._down[a] + (b - a).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text and at most ``rows`` rows."""
    ends = np.cumsum(lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + limit, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def _with_texts(column: pa.Array) -> pa.Array:
    return (column.fill_null("") if column.null_count else column).cast(pa.large_string())


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(utf8(column)[1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: none) and the offsets of its rows, from 0."""
    column = _with_texts(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls and the offsets of its rows, from 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets.astype(np.int64) - offsets[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]


def word_places(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run without separators, inside one row), and each row's first word."""
    return runs(~separator[raw], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes (inside one row), and each row's first run."""
    size = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < size)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each stretch: eight bytes at a time are scrambled into it, one-to-one.

    No sum of powers, so regular patterns do not cancel out; long stretches go through BLAKE2.
    """
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64), 11)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    active = np.flatnonzero((sizes > 0) & (sizes <= LONG_STRETCH))
    at, left = starts[active], sizes[active]
    while len(active):
        out[active] = mixed(out[active] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]), 1)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_STRETCH).tolist():
        digest = hashlib.blake2b(raw[starts[i]:ends[i]], digest_size=8, key=b"notelake").digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def same_stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether each stretch i has the bytes of stretch others[i]."""
    sizes = ends - starts
    if not np.array_equal(sizes, sizes[others]):
        return False
    differs = np.flatnonzero(starts != starts[others])
    at, shift = starts[differs], starts[others[differs]] - starts[differs]
    mine = ranges(at, sizes[differs])
    return np.array_equal(raw[mine], raw[mine + np.repeat(shift, sizes[differs])])


def byte_codes(raw: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[raw]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, span = values, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[:-rest], have[rest:]) if rest else have


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` consecutive hashes (by their first 34 bits; the first of equal ones)."""
    tagged = values & ~_U((1 << 30) - 1) | np.arange(len(values), dtype=np.uint64)
    return (sliding_min(tagged, width) & _U((1 << 30) - 1)).astype(np.int64)


def windows_in_rows(row_starts: np.ndarray, width: int) -> np.ndarray:
    """First positions of all windows of ``width`` that stay inside their row, in order."""
    sizes = np.maximum(np.diff(row_starts) - width + 1, 0)
    return ranges(row_starts[:-1], sizes)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size values) for each pair, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in some stretch."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
