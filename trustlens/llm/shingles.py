"""Word shingle sets as sorted 64-bit hashes, and their min-wise signatures."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


# A word's hash is the sum, modulo 2**64, of a random number for each byte times an odd base to
# the power of its place, so that all words of a text are hashed by one running sum.
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8
_UNBASE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 4096), _powers(_UNBASE, 4096)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _P
    return x ^ (x >> _U(29))


def _block_words(a: np.ndarray) -> np.ndarray:
    global _UP, _DOWN
    if len(a) > len(_UP):
        n = 1 << len(a).bit_length()
        _UP, _DOWN = _powers(_BASE, n), _powers(_UNBASE, n)
    gap = np.concatenate(([True], _SPACE[a], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    run = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * _UP[:len(a)], out=run[1:])
    return _mix((run[ends] - run[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64) * _P)


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of the text's words: runs of what is not ASCII white space, A-Z lower-cased."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    parts, at = [], 0
    while at < len(a):
        end = min(at + _BLOCK, len(a))
        while end < len(a) and not _SPACE[a[end]]:  # a block ends where a word does
            more = np.flatnonzero(_SPACE[a[end:end + _BLOCK]])
            end = end + int(more[0]) if len(more) else min(end + _BLOCK, len(a))
        parts.append(_block_words(a[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, words: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``words`` words.  A text of fewer words is
    one shingle, no word none."""
    h = word_hashes(text)
    n = min(words, len(h))
    if not n:
        return h
    run = h[n - 1:]
    for i in range(n - 2, -1, -1):
        run = h[i:i + len(run)] * _Q + _mix(run)
    return np.unique(_mix(run))


class Signer:
    """``k`` min-wise hashes, of each the ``bits`` (at most 16) that a signature keeps."""

    def __init__(self, k: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 1 << 63, k, dtype=np.uint64) << _U(1)) | _U(1)
        self.b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        self.mask = _U((1 << bits) - 1)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(shingles), 4096):
            np.minimum(least, (np.multiply.outer(self.a, shingles[i:i + 4096])
                               + self.b[:, None]).min(axis=1), out=least)
        return ((least >> _U(20)) & self.mask).astype("<u2")


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y| of two sorted distinct arrays."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)
