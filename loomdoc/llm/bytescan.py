"""Vectorised scans over the UTF-8 bytes of a text column.

A piece is a run of whole rows of an Arrow string column seen as one byte
array with row offsets.  Words, word hashes and shingle hashes of a piece are
computed by numpy for all its rows at once; pieces are cut at row ends so that
the arrays stay near PIECE_BYTES (a longer row makes a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


class WorkerCache(dict):
    """A dict that travels empty: what one process has computed stays there."""

    def __reduce__(self):
        return WorkerCache, ()


_powers = WorkerCache()


def lower_table() -> np.ndarray:
    """Maps each byte to itself, A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spaced_words() -> np.ndarray:
    """True for bytes of `[^\\x20\\x09-\\x0D]+` words."""
    table = np.ones(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


def letter_digit_words() -> np.ndarray:
    """True for bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` words, after lower-casing."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that sums and products of hashes look random."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n; grown by doubling and kept by the worker."""
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.ones(max(n, PIECE_BYTES + 1), dtype=np.uint64)
        done, factor = 1, base
        while done < len(table):
            upto = min(2 * done, len(table))
            np.multiply(table[: upto - done], _U(factor), out=table[done:upto])
            done, factor = upto, factor * factor % (1 << 64)
        _powers[name] = table
    return table


@dataclass
class Piece:
    """Rows first..first+len(offsets)-2 of a batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def pieces(column: pa.Array, limit: int = PIECE_BYTES, max_rows: int = 1 << 16) -> Iterator[Piece]:
    """Cuts a string column into pieces of about limit bytes and at most max_rows rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), row + max_rows, len(column))
        low, high = offsets[row], offsets[stop]
        yield Piece(row, everything[low:high], offsets[row : stop + 1] - low)
        row = stop


@dataclass
class Words:
    """Words of a piece: byte spans, and for each row the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes for which table is true; a run ends with its row."""
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: differences of one prefix sum of byte * base**position."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    weighted = data.astype(np.uint64)
    weighted += _U(1)
    weighted *= _power("up", _BASE, n)[:n]
    np.cumsum(weighted, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _U(_STEP))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of hashes[i:i+size] for each i, as if there were no rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out *= _U(_STEP | 1)
        out += hashes[i : i + n]
    return mix(out + _U(size))


def run_rows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word index of every run of size words inside one row, and the row."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(rows)) - first[rows] + bounds[:-1][rows], rows
