"""Vectorised hashing of words, shingles and byte grams.

Every function works on one contiguous ``uint8`` buffer, so a whole pack of
documents is hashed with a handful of numpy passes instead of a Python loop.

A run of bytes is hashed as ``sum(T[b_j] * B**j) * B**-start`` modulo 2**64: the
prefix sums make any sub-range O(1), ``B`` is odd and therefore invertible, and
``T`` holds 256 fixed pseudo-random 64-bit values.  A final bijective mixer
spreads the bits.  Values are the same in every process and on every machine.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Space and the five ASCII control characters that ``bytes.split`` cuts at.
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ``bytes.translate`` table: A-Z to a-z, every other ASCII non-alphanumeric to a space.
FOLD_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: ``bytes.translate`` table: A-Z to a-z and nothing else.
FOLD_CASE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


_T = _table()
_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**j`` and ``B**-j`` for j < n, kept for the next call."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """``n + 1`` prefix sums from which :func:`ranges` reads hashes."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    if len(buf):
        np.cumsum(_T[buf] * _powers(len(buf))[0], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``buf[start:end]`` for each pair."""
    inverse = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k``-byte gram, by start position."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, dtype=U64)
    return mix((sums[k:] - sums[:n]) * _powers(len(sums))[1][:n])


def word_bounds(buf: np.ndarray, gaps: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes that are not gaps."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~gaps[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ranges(prefix_sums(buf), starts, ends) if len(starts) else np.zeros(0, dtype=U64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, k, dtype=U64)
    for j in range(k):
        out += words[j : j + n] * _T[j % 256] if j < 256 else mix(words[j : j + n] * _T[j % 256] + U64(j))
        out ^= out >> U64(29)
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, span = values, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[w - span : w - span + n]) if span < w else out[:n]
