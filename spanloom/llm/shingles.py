"""Vectorised word-shingle hashing over whole Arrow batches (numpy only).

Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z.  A text's set is its
distinct ``k``-word shingles; a text of fewer words is one shingle of all its words; a text without
words has the empty set.  A shingle is identified by a 64-bit hash of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_SPAN = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions 0..n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, 1 << 16)
        for name, b in (("up", _BASE), ("down", _BASE_INV)):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(b)
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls have no bytes."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    buf = column.buffers()
    offsets = np.frombuffer(buf[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, in order, and each text's first word's index."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    text_starts = np.zeros(n + 1, dtype=bool)
    text_starts[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | text_starts[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | text_starts[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # spans of whole words, so that scratch arrays stay small
        origin = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(stops, origin + _SPAN, "right")))
        x, y = starts[at:upto] - origin, stops[at:upto] - origin
        span = data[origin : int(stops[upto - 1])]
        up, down = _powers(len(span))
        sums = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[_LOWER[span]] * up[:-1], out=sums[1:])
        h[at:upto] = mix64((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64))
        at = upto
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, and n + 1 offsets into them."""
    words, first = word_hashes(*text_buffers(column))
    n_docs, counts = len(column), np.diff(first)
    m = len(words)
    multipliers = mix64(np.arange(101, 101 + k, dtype=np.uint64))
    full = np.zeros(max(m - k + 1, 0), dtype=np.uint64)
    for j in range(k if m >= k else 0):
        full += words[j : m - k + 1 + j] * multipliers[j]
    full = mix64(full)
    per_doc = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.empty(int(per_doc.sum()), dtype=np.uint64)
    ends = np.zeros(n_docs + 1, dtype=np.int64)
    filled = 0
    for d in range(n_docs):
        a, c = first[d], counts[d]
        if c >= k:
            own = np.unique(full[a : a + c - k + 1])
        elif c > 0:
            own = words[a : a + c]
            own = mix64(np.array([(own * multipliers[:c]).sum(dtype=np.uint64) + np.uint64(c)], dtype=np.uint64))
        else:
            own = full[:0]
        out[filled : filled + len(own)] = own
        filled += len(own)
        ends[d + 1] = filled
    return out[:filled], ends


def slices(column: pa.Array, limit: int = 4 << 20, most: int = 60_000):
    """Consecutive parts of a text column, of about ``limit`` bytes and at most ``most`` texts each."""
    offsets = text_buffers(column)[1]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + most, len(column))
        yield at, column.slice(at, end - at)
        at = end
