"""Words of Arrow text columns as numpy arrays: a whole slice of texts in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 * 8 + 5 & (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text, or one longer text."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts in a row, and where each begins (with the end of the last); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """All words of some texts: start and end by byte, their 64-bit hashes, and the first word of each text."""

    def __init__(self, column: pa.Array, separators: np.ndarray = WHITE, lower: bool = False) -> None:
        data, offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        inside = ~separators[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_VALUES[self.data] * powers(_BASE, len(self.data)), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * powers(_INVERSE, len(self.data) + 1)[self.starts]
        return mix(h)


def window_hashes(words: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A hash of words[i:i + width] for every i that has as many words left."""
    if len(words) < width:
        return np.empty(0, U64)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    n = len(words) - width + 1
    return mix((total[width:] - total[:-width]) * powers(pow(base, -1, 1 << 64), n))
