"""Word and shingle hashing over whole Arrow batches with numpy.

Text is handled as UTF-8 bytes straight from the Arrow buffers; a word is a run of bytes that a 256-entry table admits.
A word's hash is a polynomial over per-byte random values, taken from one running sum over the batch, so no step loops
over words or documents in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
#: Bytes handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Runs without ASCII white space.
NON_SPACE = ~_SPACE
#: Digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept up to a slice's length."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, SLICE_BYTES + 1)
    out = np.empty(size, np.uint64)
    out[0], done = 1, 1
    while done < size:
        step = min(done, size - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    if size == SLICE_BYTES + 1:
        _powers[base] = out
    return out[:n]


@dataclass
class Words:
    """The words of some documents: rows are document positions within the batch."""

    data: np.ndarray  # bytes of the slice
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    row: np.ndarray  # document of each word
    first: np.ndarray  # for each document, its first word; one more entry at the end


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of documents of about `size` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words_of(data: np.ndarray, offs: np.ndarray, admit: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = admit[data]
    n, full = len(data), np.flatnonzero(offs[1:] > offs[:-1])
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offs[full]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offs[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offs)
    return Words(data, starts, ends, np.repeat(np.arange(len(offs) - 1), np.diff(first)), first)


def word_hashes(w: Words) -> np.ndarray:
    run = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(_BYTE[w.data] * _power(_BASE, len(w.data)), out=run[1:])
    inverse = _power(pow(_BASE, -1, 1 << 64), len(w.data) + 1)
    return mix((run[w.ends] - run[w.starts]) * inverse[w.starts] + (w.ends - w.starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all runs of k words within one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j : j + n] * np.uint64(pow(_BASE ^ 0x5851F42D4C957F2D | 1, j, 1 << 64))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(total[at])


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct k-word shingles, sorted; a shorter text is one shingle as a whole."""
    h = word_hashes(w)
    at, grams = gram_hashes(h, w.row, k)
    rows = w.row[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            whole[has] += h[w.first[short[has]] + j] * np.uint64(pow(_BASE ^ 0x5851F42D4C957F2D | 1, j, 1 << 64))
        grams = np.concatenate([grams, mix(whole + count[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[keep], grams[keep]
