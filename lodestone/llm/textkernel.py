"""Vectorised text kernels shared by the training-data operators.

Arrow string batches are handled as one byte buffer plus row offsets, so no
Python string is made per word.  Hashes chain or pair their input through a bit mixer;
they depend on content only, never on position, task or interpreter, so a lost task
recomputes the same values.  What must name a text or passage among all others has a
cryptographic digest of its bytes instead.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds a task's temporary arrays.
CHUNK_BYTES = 1 << 19

# The separators of a word, 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Odd multipliers, one row for each independent hash.
_ODD = np.random.default_rng(20240607).integers(1, 2**62, size=(4, 4), dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Longer spans of bytes go to a cryptographic hash, one call each.
LONG_SPAN = 1024
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every place of raw (zeros behind its end) as an unaligned view."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))


def bytes_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of raw[start:end] for each pair; which picks an independent hash.

    Eight bytes at a time go through the mixer, so no linear structure of a text (as of
    a polynomial modulo 2**64) makes spans collide; spans of one length up to eight bytes never do.
    """
    n = end - start
    odd = _ODD[which]
    out = mix((n.astype(U64) + U64(1)) * odd[0])
    long = np.flatnonzero(n > LONG_SPAN)
    if len(long):
        data = memoryview(np.ascontiguousarray(raw))
        seed = odd[0].tobytes()
        digests = b"".join([hashlib.blake2b(data[a:b], digest_size=8, key=seed).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        out[long] = np.frombuffer(digests, dtype="<u8")
    eights = _eights(raw)
    rows = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    at, left, state = start[rows], n[rows], out[rows]
    while len(rows):
        state = mix((state ^ (eights[at] & _KEEP[np.minimum(left, 8)])) * odd[1] + odd[2])
        more = left > 8
        if not more.all():
            out[rows[~more]] = state[~more]
            rows, at, left, state = rows[more], at[more], left[more], state[more]
        at, left = at + 8, left - 8
    return out


def equal_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether a[a_start:a_end] equals b[b_start:b_end], for each pair of spans."""
    n = a_end - a_start
    out = n == b_end - b_start
    for i in np.flatnonzero(out & (n > LONG_SPAN)):
        out[i] = np.array_equal(a[a_start[i] : a_end[i]], b[b_start[i] : b_end[i]])
    eights_a, eights_b = _eights(a), _eights(b)
    rows = np.flatnonzero(out & (n > 0) & (n <= LONG_SPAN))
    x, y, left = a_start[rows], b_start[rows], n[rows]
    while len(rows):
        same = ((eights_a[x] ^ eights_b[y]) & _KEEP[np.minimum(left, 8)]) == 0
        out[rows[~same]] = False
        more = same & (left > 8)
        rows, x, y, left = rows[more], x[more] + 8, y[more] + 8, left[more] - 8
    return out


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of the sequence values[start:end] for each pair; which picks an independent hash.

    A span is the sequence of its runs of 1, 2, 4 .. values by the binary digits of its length, and
    a run hashes the pair of its halves; every step is non-linear.
    """
    n = end - start
    odd = _ODD[which]
    out = mix((n.astype(U64) + U64(1)) * odd[0])
    longest = int(n.max()) if len(n) else 0
    level, at, width = values * odd[3], start.copy(), 1
    while width <= longest:
        rows = np.flatnonzero(n & width)
        if len(rows) == len(n):
            out = mix((out ^ level[at]) * odd[1] + odd[2])
            at += width
        elif len(rows):
            out[rows] = mix((out[rows] ^ level[at[rows]]) * odd[1] + odd[2])
            at[rows] += width
        if 2 * width <= longest:
            level = level[:-width] * odd[1] + level[width:] * odd[2]
            level ^= level >> U64(32)
        width *= 2
    return out


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, a row at least."""
    if not batch.num_rows:
        return
    _, offsets = string_buffer(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last
    release()


def release() -> None:
    """Give freed memory back: Spark keeps Python workers, and a worker's allocator keeps its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Words:
    """Words of each row of a byte buffer: maximal runs of non-separator bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.raw, self.offsets = raw, offsets
        inside = np.zeros(len(raw) + 2, dtype=bool)
        np.logical_not(separators[raw], out=inside[1:-1])
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        #: rows[i]:rows[i + 1] are the words of row i
        self.rows = np.searchsorted(self.start, offsets)

    def hashes(self, which: int = 0) -> np.ndarray:
        return bytes_hash(self.raw, self.start, self.end, which)

    def digests(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the words first .. last - 1, each ended by one space, as two numbers."""
        n = self.end - self.start
        ends = np.cumsum(n + 1)
        bounds = np.concatenate([[0], ends])
        plain = np.full(bounds[-1], 0x20, dtype=np.uint8)
        inside = np.ones(len(plain), dtype=bool)
        inside[ends - 1] = False
        mark = np.zeros(len(self.raw) + 1, dtype=np.int8)
        mark[self.start] += 1
        mark[self.end] -= 1
        plain[inside] = self.raw[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
        data, digest = memoryview(plain), hashlib.blake2b
        both = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(bounds[first].tolist(), bounds[last].tolist(), strict=True)])
        pairs = np.frombuffer(both, dtype="<u8").reshape(-1, 2)
        return pairs[:, 0].copy(), pairs[:, 1].copy()

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def grams(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every k-word window inside a row, and the windows' row bounds."""
    counts = np.maximum(np.diff(rows) - k + 1, 0)
    bounds = np.zeros(len(rows), dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    first = np.arange(bounds[-1]) + np.repeat(rows[:-1] - bounds[:-1], counts)
    return first, bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(firsts, lengths)
