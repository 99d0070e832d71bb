"""Vectorised kernels over UTF-8 text held in Arrow batches.

Everything works on flat byte buffers: a batch of texts is one ``uint8`` array
plus document offsets, words are (start, end) ranges in it, and hashes are
``uint64`` arrays.  Batches are cut into slices of bounded bytes before any
kernel runs, so memory follows the slice (or the longest text) and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_PAD = 16

#: Byte classes: 1 for bytes that belong to a word.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

U = np.uint64
_M1, _M2, _M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over batches, with its freed memory released when the task ends."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of at most ``limit`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and offsets, starting at 0; copies, padded by unread zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(_PAD, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    out = np.zeros(offs[-1] - offs[0] + _PAD, np.uint8)
    if data is not None and offs[-1] > offs[0]:
        out[: -_PAD] = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return out, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more at the end)."""
    n = int(offs[-1])
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data[:n]]
    change = inside[1:] != inside[:-1]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    touching = edges[inside[edges] & inside[edges + 1]]  # words that meet at a document's edge
    at = np.flatnonzero(change)
    if touching.size:
        at = np.sort(np.concatenate([at, np.repeat(np.unique(touching), 2)]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; ``data`` has 8 readable bytes after each range."""
    lens = ends - starts
    eight = np.ndarray((max(0, data.size - 7),), "<u8", data, strides=(1,))
    h = mix((eight[starts] & _KEEP[np.minimum(lens, 8)]) + _M3 * lens.astype(U)) if starts.size else np.zeros(0, U)
    rest, k = np.flatnonzero(lens > 8), 8
    while rest.size:
        part = eight[starts[rest] + k] & _KEEP[np.minimum(lens[rest] - k, 8)]
        h[rest] = mix(h[rest] * _M3 + part)
        k += 8
        rest = rest[lens[rest] > k]
    return h


def grams(h: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a document and the index of each run's first word."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = h[:n].copy()
    for i in range(1, k):
        g *= _M3
        g += h[i : i + n]
    fits = np.ones(n, bool)
    for cut in firsts[1:-1]:
        fits[max(0, cut - k + 1) : cut] = False
    at = np.flatnonzero(fits)
    return mix(g[at]), at


def per_doc(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values between firsts; zero for empty documents."""
    total = np.zeros(values.size + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]


def owners(firsts: np.ndarray) -> np.ndarray:
    """For each item between firsts its document's index."""
    return np.repeat(np.arange(firsts.size - 1), np.diff(firsts))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+len."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    full = lens > 0
    s, n = starts[full], lens[full]
    step[0] = s[0]
    heads = np.cumsum(n)[:-1]
    step[heads] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(step)


_BASE, _INVERSE = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U) * _M3)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> list[np.ndarray]:
    if _powers[0].size < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


class Rolling:
    """Polynomial hashes of any byte range of a buffer, from one prefix sum modulo 2**64."""

    def __init__(self, data: np.ndarray, n: int):
        up, self.down = _power(n + 1)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data[:n]] * up[:n], out=self.prefix[1:])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all k-byte windows."""
        h = self.prefix[k:] - self.prefix[:-k]
        h *= self.down[: h.size]
        return mix(h)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(h + _M3 * (ends - starts).astype(U))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(keys.size, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
