"""Vectorised word kernels shared by the corpus operators.

A batch of documents is one run of UTF-8 bytes plus offsets (the layout Arrow
already has). Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, the
same set that ``bytes.split()`` cuts at. Fingerprints are polynomial hashes
modulo 2**64 taken from prefix sums, so every window of every document costs a
few array operations and no Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text handled at once by the kernels; a longer single document is one slice of its own.
SLICE_BYTES = 4 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, dtype=U, endpoint=False)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


class _Powers:
    """Powers and inverse powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, base, U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE[0]), _Powers(_BASE[1])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (one more at the end)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    word = ~_SEP[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begin[inner] = word[inner]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = word[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


#: Bytes that word_keys holds sums of at once.
_RUN = 1 << 19


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes; starts ascend. It does not depend on where the word stands."""
    if len(data) <= _RUN or len(starts) < 2:
        return _word_keys(data, starts, ends)
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _RUN)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = _word_keys(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _BYTES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


class Rolling:
    """Fingerprints of word windows over one run of word keys."""

    def __init__(self, keys: np.ndarray):
        self.up, self.down = _WORDS.upto(len(keys) + 1)
        self.sums = np.zeros(len(keys) + 1, U)
        np.cumsum(keys * self.up[: len(keys)], out=self.sums[1:])

    def at(self, first: np.ndarray, n) -> np.ndarray:
        """Of the n words from each index in first on."""
        return mix((self.sums[first + n] - self.sums[first]) * self.down[first] + np.asarray(n).astype(U))


def window_starts(first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all words that start a window of n words within their document, and those documents' indexes."""
    counts = np.maximum(np.diff(first_word) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    skipped = first_word[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    return np.arange(len(doc)) + skipped[doc], doc


def slices(batches, limit: int = SLICE_BYTES, text: str = "text"):
    """Regroup Arrow batches into runs of rows of about ``limit`` bytes of text, never cutting a row."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            room = np.cumsum(lengths[at:])
            n = int(np.searchsorted(room, limit - size, "right"))
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(at, n))
                size += int(room[n - 1])
                at += n
            if at < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[starts[i]:ends[i]] as one binary array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])
