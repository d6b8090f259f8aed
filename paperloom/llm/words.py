"""Vectorised splitting of Arrow string columns into words, and hashes of words and word runs.

Everything works on the Arrow byte buffer of a slice of documents (a few MB at a time, a single
longer document alone), so memory is bounded by the longest document, not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SLICE_BYTES = 1 << 19

#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that separate terms: all ASCII but letters and digits.
NOT_TERM = np.ones(256, dtype=bool)
NOT_TERM[0x80:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    NOT_TERM[_a:_b] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = (out[0], out[1])
        if size <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one longer than values."""
    p = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(base, len(values))[0], out=p[1:])
    return p


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values in [start, end), equal for equal sequences wherever they stand.

    For short runs of values that are themselves hashes; long runs of two chosen values can collide.
    """
    return (p[end] - p[start]) * powers(base, len(p))[1][start]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(the number of each byte range's value, the values by number), told apart by their bytes.

    Ranges are in ascending order and don't overlap.
    """
    if not len(start):
        return np.zeros(0, dtype=np.int64), pa.array([], pa.large_binary())
    gapless = bool((end[:-1] == start[1:]).all())
    if gapless:
        edges = np.append(start, end[-1])
    else:  # what lies between two ranges is a value of its own, left out below
        edges = np.column_stack([start, end]).ravel()
    column = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return np.asarray(coded.indices)[:: 1 if gapless else 2].astype(np.int64), coded.dictionary


def digests(values: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of each value's bytes, as (values, 2)."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(v) for v in values.to_pylist()]), "<u8").reshape(-1, 2)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one Arrow array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    return column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a null-free string column and the offsets of its rows in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes; a longer text stands alone."""
    col = strings(batch.column(text))
    off = raw(col)[1]
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    _trim()


def _trim() -> None:
    """Gives freed memory back to the system: workers are used again by later stages."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
        except OSError:
            _libc = False
    if _libc and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


_libc = None


@dataclass
class Words:
    """Words of a run of documents: byte ranges, and the words' ranges by document."""

    data: np.ndarray  #: bytes of all texts
    text: np.ndarray  #: offsets of texts in data, one more than texts
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: one past its last byte
    first: np.ndarray  #: number of words before each text, one more than texts

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.text) - 1), self.per_text)

    def distinct(self, data: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
        """The number of each word's value, and the values by number."""
        return distinct(self.data if data is None else data, self.start, self.end)

    def hashes(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the words' bytes."""
        number, values = self.distinct(data)
        both = digests(values)
        return both[number, 0], both[number, 1]


def split(column: pa.Array, separators: np.ndarray = SPACE) -> Words:
    """The words of each text: longest runs of bytes that are no separators."""
    data, off = raw(strings(column))
    inside = ~separators[data] if len(data) else np.zeros(0, bool)
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = off[1:-1]
        at = edge[edge < len(data)]
        begins[at] = inside[at]
        at = edge[edge > 0] - 1
        ends[at] = inside[at]
    start = np.flatnonzero(begins)
    return Words(data, off, start, np.flatnonzero(ends) + 1, np.searchsorted(start, off, "left"))


def normal_form(w: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, each followed by one space: the bytes, and each word's start and end in them."""
    length = w.end - w.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(length.sum()) + len(length), 0x20, dtype=np.uint8)
    if len(length):
        src = np.repeat(w.start - start, length) + (fill := np.repeat(start, length) + _ramps(length))
        out[fill] = LOWER[w.data[src]] if lower else w.data[src]
    return out, start, end


def _ramps(length: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in length, in a row."""
    total = int(length.sum())
    return np.arange(total) - np.repeat(np.cumsum(length) - length, length)
