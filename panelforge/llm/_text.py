"""Vectorised word and shingle kernels over Arrow string columns.

Texts are handled as UTF-8 bytes in pieces of bounded size.  Words are hashed with a
polynomial prefix hash (position independent, so the cut into pieces does not matter),
finalised by a 64-bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes of text handled at once (a longer text is one piece)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE):
    """(slice, bytes, offsets): parts of the batch of about ``limit`` bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    pw = powers(len(data) + 1)[0]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def word_spans(lowered: np.ndarray, off: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word index of each document + total): maximal runs of bytes outside ``stop``; runs never cross texts."""
    inside = np.zeros(len(lowered) + 2, bool)
    inside[1:-1] = ~stop[lowered]
    begin = inside[1:] & ~inside[:-1]
    close = inside[:-1] & ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(lowered))]
    cut = cut[inside[cut] & inside[cut + 1]]
    begin[cut] = True
    close[cut] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(close)
    return start, end, np.searchsorted(start, off)


def shingles(data: np.ndarray, off: np.ndarray, k: int, stop: np.ndarray = SPACE):
    """Yields for each text its sorted distinct k-word shingle hashes (fewer words: the whole sequence as one; none: empty)."""
    low = LOWER[data]
    start, end, first = word_spans(low, off, stop)
    h = span_hash(prefix_hash(low), start, end)
    c = [mix(np.array([7919 * (j + 1)], np.uint64))[0] | np.uint64(1) for j in range(k)]
    n = len(h)
    acc = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        acc += h[j : n - k + 1 + j] * c[j] if len(acc) else acc
    acc = mix(acc)
    for d in range(len(off) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            s = np.sort(acc[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            t = np.array([b - a], np.uint64)
            for j in range(b - a):
                t = t * np.uint64(3) + h[a + j : a + j + 1] * c[j]
            yield mix(t)
        else:
            yield np.zeros(0, np.uint64)
