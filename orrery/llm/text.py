"""Words and n-grams of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 mod 2 ** 64."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        size, out = max(1 << 16, 1 << int(n - 1).bit_length()), np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        had = _powers[base] = out
    return had[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), each followed by a line break, and where each starts (one more: the end)."""
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    return np.insert(data, offsets[1:], 10), offsets + np.arange(n + 1)


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about that many bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(data: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't apart. The last byte has to be one that is."""
    edge = np.diff(np.concatenate([[True], apart[data]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; it depends on those bytes alone."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n words in a row of one document, and whether those at this start all lie in it."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = words[:m].copy()
    for k in range(1, n):
        out *= np.uint64(_BASE)
        out += words[k : k + m]
    return mix(out), doc[:m] == doc[n - 1 :]
