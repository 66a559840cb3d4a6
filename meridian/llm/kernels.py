"""Vectorised byte and word kernels shared by the operators of this subpackage.

All hashes are 64 bits wide, unsalted and equal on every machine, so partial results of different executors can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(n, BASE), np.full(n, INVERSE)
        up[0] = down[0] = 1
        _powers[0] = have = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random number for each byte at each of the first positions of a word; later blocks of positions multiply them by an odd number of their own.
_BLOCK = 64
_ZOBRIST = mix(np.arange(_BLOCK * 256, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: sums of random numbers by byte and position, which no pattern of the words' letters makes collide."""
    size = ends - starts
    stop = np.cumsum(size)
    where = np.repeat(starts - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    position = where - np.repeat(starts, size)
    value = _ZOBRIST[(position & (_BLOCK - 1)) * 256 + data[where]]
    if len(size) and size.max() > _BLOCK:
        value = value * (mix(position.astype(U64) // U64(_BLOCK)) | U64(1))
    total = np.add.reduceat(value, stop - size) if len(size) else np.zeros(0, U64)
    return mix(total + size.astype(U64))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the bytes [i, j) hash to (sums[j] - sums[i]) * down[i], wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def text_parts(column: pa.Array, most: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of at most `rows` rows that hold about `most` bytes; null counts as empty. A single longer text is its own run."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs without white space (0x20, 0x09-0x0D); none crosses a row."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): row r's set of k-word shingles, A-Z lowered, is hashes[bounds[r]:bounds[r + 1]], ascending and distinct.

    With fewer than k words, the sequence of all words is the only shingle; without words the set is empty."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    h = word_hashes(data, starts, ends)
    count = np.bincount(row, minlength=n)
    begin = np.concatenate(([0], np.cumsum(count)))
    full = np.arange(max(0, len(h) - k + 1))
    full = full[row[full] == row[full + k - 1]]
    out = np.zeros(len(full), U64)
    for i in range(k):
        out = out * BASE + h[full + i]
    rows = row[full]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] = extra[has] * BASE + h[begin[short[has]] + i]
        out, rows = np.concatenate((out, extra + U64(77))), np.concatenate((rows, short))
    out = mix(out)
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    out, rows = out[keep], rows[keep]
    return out, np.searchsorted(rows, np.arange(n + 1))
