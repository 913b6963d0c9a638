"""Hashes of words, word shingles and their MinHash signatures, computed over whole batches with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from claimspark.llm.common import LOWER_ASCII

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for which, step in enumerate((BASE, INVERSE)):
            factors = np.full(size, step, dtype=np.uint64)
            factors[0] = 1
            _powers[which] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a UTF-8 text."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~IS_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, in order; only A-Z are lower-cased."""
    data = np.frombuffer((text.translate(LOWER_ASCII) if lower else text).encode("utf-8", "replace"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    starts, ends = word_spans(data)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + hashes[j:j + n]
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct k-word shingles; a text of fewer words is one shingle, without words none."""
    hashes = word_hashes(text or "")
    return np.unique(windows(hashes, min(k, len(hashes)))) if len(hashes) else hashes


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class MinHash:
    """``size`` minima of a shingle set under fixed random functions, 32 bits each."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def signatures(self, sets: list[np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
        """One row per set; sets must not be empty. Work arrays stay within ``chunk`` values or one set."""
        out = np.empty((len(sets), len(self.a)), dtype=np.uint32)
        at = 0
        while at < len(sets):
            end, n = at + 1, len(sets[at])
            while end < len(sets) and n + len(sets[end]) <= chunk:
                n += len(sets[end])
                end += 1
            x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end - 1]])]).astype(np.int64)
            for k in range(len(self.a)):
                out[at:end, k] = np.minimum.reduceat(x * self.a[k] + self.b[k], offsets)
            at = end
        return out


def groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of every run of equal keys."""
    if len(keys):
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist())
