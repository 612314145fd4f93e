"""Vectorised byte-level text features over Arrow string columns (numpy only).

A batch of texts is one byte buffer plus offsets, so hashing words, shingles
and n-grams costs a few array operations for the whole batch and no Python
work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C55  # odd, so invertible modulo 2**64
_PINV = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (in place on a copy)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1 entries starting at 0, is_null) of a string or binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    null = np.asarray(col.is_null()) if col.null_count else np.zeros(n, bool)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null slot may span bytes: give it none
        lens = np.where(null, 0, np.diff(offsets))
        if (lens != np.diff(offsets)).any():
            parts = [raw[a:b] for a, b, z in zip(offsets[:-1], offsets[1:], null, strict=True) if not z]
            raw = np.concatenate(parts) if parts else raw[:0]
            offsets = np.concatenate([[0], np.cumsum(lens)])
            return raw, offsets, null
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], null


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        m = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[U64(1)], np.full(m - 1, _P, U64)]), dtype=U64)
            _inverses = np.cumprod(np.concatenate([[U64(1)], np.full(m - 1, _PINV, U64)]), dtype=U64)
    return _powers[:n], _inverses[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def is_space(data: np.ndarray) -> np.ndarray:
    """The bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-space bytes; runs end at text borders."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~is_space(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text border
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by one prefix sum of a polynomial modulo 2**64."""
    pw, inv = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        pre = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * pw[:-1], out=pre[1:])
        h = (pre[end] - pre[start]) * inv[start]
        return mix64(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(word_hash: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their rows; a row of fewer words gives its whole sequence as one."""
    if not len(word_hash):
        return word_hash, row
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    with np.errstate(over="ignore"):
        m = len(word_hash) - k + 1
        if m > 0:
            acc = np.zeros(m, U64)
            for j in range(k):
                acc = acc * U64(0x9FB21C651E98DF25) + word_hash[j : j + m]
            inside = row[:m] == row[k - 1 :]
            long_h, long_r = mix64(acc[inside] + U64(k)), row[:m][inside]
        else:
            long_h, long_r = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        acc, taken = np.zeros(len(short), U64), counts[short]
        for j in range(k - 1):
            on = taken > j
            acc[on] = acc[on] * U64(0x9FB21C651E98DF25) + word_hash[first[short[on]] + j]
        short_h = mix64(acc + taken.astype(U64))
    h, r = np.concatenate([long_h, short_h]), np.concatenate([long_r, short])
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, first): every text with a space before it and one after the last; white space made spaces.

    ``first[i]`` is the place of the space before text i.
    """
    n_rows = len(offsets) - 1
    buf = np.full(len(data) + n_rows + 1, 32, np.uint8)
    keep = np.ones(len(buf), bool)
    first = offsets[:-1] + np.arange(n_rows)
    keep[first] = False
    keep[-1] = False
    buf[keep] = np.where(is_space(data), np.uint8(32), data)
    return buf, first


def gram_buckets(buf: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the n bytes at each place, and whether they lie in one word.

    A gram may begin or end with the space beside its word, and is not counted
    if a space is inside it or if it is spaces alone.
    """
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        acc = np.full(m, (2166136261 + n * 97) & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            acc ^= buf[j : j + m]
            acc *= np.uint32(16777619)
        acc *= np.uint32(2654435761)
    space = buf == 32
    if n == 1:
        inside = ~space[:m]
    elif n == 2:
        inside = ~(space[:m] & space[1 : 1 + m])
    else:
        inside = ~space[1 : 1 + m]
        for j in range(2, n - 1):
            inside &= ~space[j : j + m]
    return acc >> np.uint32(32 - bits), inside
