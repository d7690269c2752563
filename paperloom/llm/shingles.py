"""Hashes of all word shingles of a batch of texts in a few array passes.

A word is a run of bytes other than white space (0x20, 0x09-0x0D) of the UTF-8 text. Every word gets the
value of a polynomial in an odd base modulo 2^64, taken as a difference of prefix sums, then a mixing step;
five neighbouring word values make a shingle. A text of one to four words is one shingle of those words; a
text without a word has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(WORDS)], dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[::2], edge[1::2]
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return hashes, counts


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle in order, number of shingles of each text)."""
    words, counts = word_hashes(texts)
    n = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(counts.dtype))
    total = int(n.sum())
    if not total:
        return np.empty(0, np.uint64), n
    first = np.cumsum(counts) - counts
    start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
    left = np.repeat(first + counts, n) - start  # words that remain in the text
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    out = np.zeros(total, np.uint64)
    for k in range(WORDS):
        out += np.where(left > k, padded[start + k], np.uint64(0)) * _MULT[k]
    return mix(out), n


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of shingles: (text index, shingle hash, count), ordered by the first two."""
    hashes, n = shingle_hashes(texts)
    if not len(hashes):
        return np.empty(0, np.int64), hashes, np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.empty(len(hashes), bool)
    new[0] = True
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))


def weighted_jaccard(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser counts over the sum of the greater; 0 where both are empty."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(one[1][i], two[1][j]).sum())
    union = int(one[1].sum()) + int(two[1].sum()) - both
    return both / union if union else 0.0
