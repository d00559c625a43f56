"""Vectorised word and shingle hashes of one text, used inside Arrow batch functions."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_CHUNK = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.ones(_CHUNK + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span of one piece of at most ``_CHUNK`` bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased.

    A text of any length is hashed in pieces that end between words; only a single word longer than a
    piece makes its piece longer.
    """
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(data) <= _CHUNK:
        return _hash_spans(data, start, end)
    out, at = [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _CHUNK, side="right")))
        low, high = int(start[at]), int(end[to - 1])
        if high - low <= _CHUNK:
            out.append(_hash_spans(data[low:high], start[at:to] - low, end[at:to] - low))
        else:  # one word longer than a piece: chain the hashes of its pieces
            value = np.zeros(1, np.uint64)
            for p in range(low, high, _CHUNK):
                size = min(_CHUNK, high - p)
                value = mix(value * np.uint64(_BASE) + _hash_spans(data[p : p + size], np.array([0]), np.array([size])))
            out.append(value)
        at = to
    return np.concatenate(out)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    size = min(width, len(words))
    value = np.full(n, np.uint64(size))
    for i in range(size):
        value = mix(value * np.uint64(_BASE) + words[i : i + n])
    return np.unique(value)
