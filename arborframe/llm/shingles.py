"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes that are not ASCII white space, A-Z lower-cased. A word's hash is a polynomial over a
random table of its bytes, by prefix sums over the whole slice; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACES, slices, splitmix

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_table = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_table[65:91] = _table[97:123]
_blank = np.zeros(256, bool)
_blank[list(SPACES.encode())] = True
_mix = np.random.default_rng(12).integers(0, 1 << 64, 64, dtype=np.uint64) | _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            a = np.full(n, _U(base))
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    for a, b in slices(texts):
        part = texts[a:b]
        raw = np.frombuffer(b"\n" + b"\n".join(part) + b"\n", dtype=np.uint8)
        blank = _blank[raw]
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        up, down = _power(len(raw))
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_table[raw] * up, out=sums[1:])
        words = splitmix((sums[ends] - sums[starts]) * down[starts])
        bounds = np.searchsorted(starts, 1 + np.cumsum([0, *(len(t) + 1 for t in part)]))
        for i in range(len(part)):
            yield words[bounds[i] : bounds[i + 1]]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size_used = min(size, len(words))
    n = len(words) - size_used + 1
    h = np.full(n, _U(size_used))
    for k in range(size_used):
        h += words[k : k + n] * _mix[k]
    return np.unique(splitmix(h))
