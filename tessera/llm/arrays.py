"""NumPy kernels over the UTF-8 bytes of an Arrow text column.

Texts are never turned into Python strings here: words, word hashes and window hashes
come from whole-column array operations, in slices of a few megabytes, so the memory
in use is bounded by the slice (or by the longest single text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE_BYTE, _BASE_WORD = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
SLICE_BYTES = 1 << 20

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_byte_digit = mix(np.arange(1, 257, dtype=np.uint64) * _BASE_BYTE)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64; long tables are not kept."""

    KEPT = (1 << 20) + 64

    def __init__(self, base: np.uint64):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least ``n`` entries of both."""
        up, down = self.up, self.down
        if len(up) < n:
            size = n if n > self.KEPT else min(self.KEPT, 1 << (n - 1).bit_length())
            while len(up) < size:
                k = len(up)
                more = min(k, size - k)
                up = np.concatenate([up, up[:more] * _U(pow(self.base, k, 1 << 64))])
                down = np.concatenate([down, down[:more] * _U(pow(self.inverse, k, 1 << 64))])
            if size <= self.KEPT:
                self.up, self.down = up, down
        return up, down


_bytes, _words, _others = Powers(_BASE_BYTE), Powers(_BASE_WORD), Powers(_U(0xA0761D6478BD642F))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def nullable(kind: pa.DataType) -> pa.DataType:
    """The same type with all fields nullable, as Spark's schemas of Python functions have them."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(nullable(kind.value_type))
    return kind


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of non-space bytes, and n + 1 word offsets by text."""
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~_space[data]
    inside[-1] = False
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    before_start = before.copy()
    before_start[cuts] = False
    starts = np.flatnonzero(inside & ~before_start)
    ends_mask = before & ~inside
    ends_mask[cuts] |= before[cuts]
    ends = np.flatnonzero(ends_mask)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    if lower:
        data = _lower[data]
    up, down = _bytes.of(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_digit[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` consecutive word hashes (text borders ignored).

    ``second`` gives another, independent hash.
    """
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = (_others if second else _words).of(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * down[: n - width + 1])


def inside_texts(word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows that lie in one text, and how many each text has."""
    counts = np.maximum(np.diff(word_offsets) - width + 1, 0)
    total = int(counts.sum())
    begin = np.repeat(word_offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return begin + np.arange(total), counts
