"""Hashes of words and of runs of words, for whole texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: For each byte, 1 for lower-cased letters and digits and whatever lies beyond ASCII, 2 for white space and controls, 3 for punctuation.
WORD, SPACE, MARK = 1, 2, 3
KIND = np.array([WORD if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else SPACE if c <= 32 or c == 127 else MARK for c in range(256)], np.uint8)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each run; equal runs have equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """The hash of each word of a text: runs of letters and digits, A-Z lower-cased."""
    data = np.frombuffer(text.encode().translate(LOWER), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = KIND[data] == WORD
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return run_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of n neighbours."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - n + 1, (seed * _BASE + n) % (1 << 64), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out


def shingles(text: str, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of n words of a text, ascending by hash, and how often each occurs.

    A text of fewer words has one run, all its words; a text without words has none.
    """
    words = word_hashes(text)
    runs = grams(words, min(n, len(words))) if len(words) else words
    return np.unique(runs, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of the counts; 0 where both are empty."""
    total = int(a[1].sum()) + int(b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)
