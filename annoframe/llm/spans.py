"""Vectorised text helpers that run inside Arrow tasks: word spans, span hashes, per-row pieces.

A batch of texts is one UTF-8 buffer plus row offsets. Spans are byte ranges of that buffer. A span is
read as 8-byte blocks and each block is mixed into its name by multiplying and shifting, so that no
structure of the text survives in it; spans of more than ``LONG`` bytes go through xxh3. Equal bytes give
equal names in every task; two different ones have one name with a chance near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are worked on in slices of about this many bytes, so that a task's arrays stay small.
SLICE_BYTES = 2 << 20
#: For work that keeps several arrays of all words or letters of a slice.
SMALL_SLICE = 1 << 20
#: Spans of more bytes are named by xxh3.
LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
# The bytes that belong to a block of which n are left.
_PART = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that every bit of a name depends on every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[buf]


class Blocks:
    """Spans of a buffer read as little-endian numbers of 8 bytes, zeros after a span's end."""

    def __init__(self, buf: np.ndarray):
        held = np.zeros(len(buf) + 8, np.uint8)
        held[: len(buf)] = buf
        self.at = np.ndarray((len(buf) + 1,), np.dtype("<u8"), held, strides=(1,))

    def __call__(self, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The block at each ``start``, of which ``left`` bytes (or 8) belong to the span."""
        return self.at[start] & _PART[np.minimum(left, 8)]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit names of ``buf[start:end]``; with ``fold_case`` A-Z count as a-z."""
    if fold_case:
        buf = lower(buf)
    block, length = Blocks(buf), end - start
    # The length is part of the name, and an empty span has one too.
    out = mix(block(start, length) ^ (length.astype(np.uint64) * _STEP))
    more, done = np.flatnonzero((length > 8) & (length <= LONG)), 8
    while len(more):
        out[more] = mix(out[more] * _STEP + block(start[more] + done, length[more] - done))
        done += 8
        more = more[length[more] > done]
    for i in np.flatnonzero(length > LONG):
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return out


class Texts:
    """Some rows' texts as one buffer: ``buf`` holds the bytes, row i is ``buf[at[i]:at[i + 1]]``."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, first: int):
        self.buf, self.at, self.first, self.rows = buf, at, first, len(at) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end of each run of bytes other than space and 0x09-0x0D, and each row's first word."""
        apart = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edge = np.zeros(len(self.buf) + 1, dtype=bool)
        edge[self.at] = True  # a word never crosses rows
        inside = ~apart
        if not len(self.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.rows + 1, np.int64)
        begins = inside.copy()
        begins[1:] &= apart[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= apart[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, self.at)


def runs(x: Texts, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that ``member`` (256 truth values) holds, and each row's first run."""
    inside = np.zeros(len(x.buf) + 2, bool)
    inside[1:-1] = member[x.buf]
    edge = np.zeros(len(x.buf) + 1, bool)
    edge[x.at] = True  # a run never crosses rows
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, x.at)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a string column in order, in slices of about ``most`` bytes; null is empty.

    A row longer than that is a slice of its own: texts are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield Texts(whole[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def rows_of(first: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` items, of which row i holds those from ``first[i]``: the row of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers ``start[i] .. start[i] + length[i] - 1`` of all i, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i holds ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
