"""Vectorised words and word hashes over the raw UTF-8 bytes of Arrow columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Those six
are single bytes in UTF-8, so words can be cut without decoding.  A word's
64-bit hash is a polynomial over random byte values, finalised by a bit mixer;
it does not depend on where the word stands.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        steps = np.full(1 << max(12, int(n - 1).bit_length()), _BASE if kind == "up" else _BASE_INV, U64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the range of its words (``n + 1`` offsets)."""
    solid = ~_SPACE[buf]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word ``buf[starts[i]:ends[i]]``."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[buf[lo:hi]] * _power("up", hi - lo)[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * _power("down", hi - lo)[s] + (e - s).astype(U64))
        i = j
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive words, across document borders too; ``len(words) - k + 1`` of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n] * SHINGLE[0]
    for j in range(1, k):
        h += words[j : j + n] * SHINGLE[j]
    h += U64(k)
    return mix(h)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words inside each document, with each document's range of them.

    A document with 1 to k-1 words gives one shingle, its whole sequence; without words, none.
    """
    n = np.diff(bounds)
    have = np.maximum(n - k + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate(([0], np.cumsum(have)))
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, U64), out_bounds
    at = np.arange(total) + np.repeat(bounds[:-1] - out_bounds[:-1], have)
    full = grams(np.concatenate((words, np.zeros(k, U64))), k)
    out = full[at]
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = words[bounds[d] : bounds[d + 1]]
        out[out_bounds[d]] = mix(np.array([(own * SHINGLE[: len(own)]).sum() + U64(len(own))], U64))[0]
    return out, out_bounds
