"""Array helpers for text inside tasks: word, shingle and prefix hashes over UTF-8 bytes. All arithmetic is mod 2^64."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240501)
#: A random number for each byte value, and an odd base with its inverse.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def prefix(raw: np.ndarray) -> np.ndarray:
    """P[i] = sum of BYTE[raw[k]] * BASE^k over k < i."""
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def spans_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end], equal for equal bytes wherever they stand."""
    return mix((p[end] - p[start]) * powers(INVERSE, len(p))[start] + (end - start).astype(np.uint64))


def _pieces(raw: bytes, size: int = 4 << 20):
    """The text in pieces cut at white space, so that long texts need little memory at once."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and not SPACES[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word `[^\\x20\\x09-\\x0D]+` of the text."""
    out = []
    for piece in _pieces(raw):
        b = np.frombuffer(piece, np.uint8)
        inside = np.empty(len(b) + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.logical_not(SPACES[b], out=inside[1:-1].view(bool))
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            out.append(spans_hash(prefix(b), start, end))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(raw: bytes, k: int = 5) -> np.ndarray:
    """A hash for each window of k words; a text of 1 to k-1 words has one shingle, a text without words none."""
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * U(BASE) + w[i : len(w) - k + 1 + i]
    return mix(h)
