"""Hashes of words, word shingles and character shingles over flat byte arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed seeds: the same text has the same hashes in every task and run.
BASE = 0x9E3779B97F4A7C15
SEED = 20_240_601
SHINGLE_WORDS = 5

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base modulo 2^64, and of its inverse."""
    return _powers(1 << max(16, n.bit_length()))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z lowered, and for each text the index of its first word (len + 1).

    Words are runs of bytes other than space and tab to carriage return; none spans two texts.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _lower[raw]
    word = ~_space[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; fewer words count as one shingle."""
    hashed, at = words(raw, offsets)
    weight = _weights()
    n = len(hashed)
    rolled = np.zeros(max(0, n - SHINGLE_WORDS + 1), dtype=np.uint64)
    for j in range(SHINGLE_WORDS):
        rolled += hashed[j : j + len(rolled)] * weight[j]
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= SHINGLE_WORDS:
            sets.append(np.unique(rolled[a : b - SHINGLE_WORDS + 1]))
        elif b > a:
            whole = (hashed[a:b] * weight[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


@lru_cache(maxsize=4)
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED + k)
    return (
        random.integers(0, 1 << 32, (k, 1), dtype=np.uint32),
        random.integers(0, 1 << 31, (k, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1),
    )


def minima(values: np.ndarray, k: int) -> np.ndarray:
    """k MinHash symbols of 16 bits of a non-empty set of 64-bit hashes."""
    flip, factor = _permutations(k)
    x = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1 << 15):
        np.minimum(best, ((x[None, i : i + (1 << 15)] ^ flip) * factor).min(axis=1), out=best)
    best = (best ^ (best >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (best >> np.uint32(16)).astype(np.uint16)
