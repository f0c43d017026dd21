"""Vectorised n-grams over many texts at once, and linear models fitted by dual coordinate descent.

Texts come as one array of UTF-8 bytes and n + 1 offsets. Nothing here uses Spark; the operators call it per chunk.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BASE = U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse mod 2^64 for i < n."""
    inverse = U(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * ODD)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = byte_codes()
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased; blanks are \\x20 and \\x09-\\x0D), and n + 1 offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.append(False, solid[:-1]) & ~edge[:-1]
    after = np.append(solid[1:], False) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    size = 1 << max(16, int(n).bit_length())
    up, down = powers(size)
    sums = np.zeros(n + 1, U)
    np.cumsum(CODES[LOWER[data]] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * ODD)
    return hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row within a text, and the text of each."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(hashes) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(hashes) - k + 1
    total = np.zeros(n, U)
    for i in range(k):
        total += hashes[i : n + i] * U((2 * i + 1) * int(ODD) & (1 << 64) - 1)
        total = total ^ (total >> U(29))
    inside = owner[:n] == owner[k - 1 :]
    return mixed(total[inside]), owner[:n][inside]


# --- linear models ---


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: np.ndarray, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss, L2 penalty) by dual coordinate descent.

    ``rows`` are (indices, values), ``signs`` +1 or -1, ``cost`` the upper bound of each dual variable. The bias is
    the weight of a feature that is always 1.
    """
    weights, bias = np.zeros(size), 0.0
    dual = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at, values = rows[i]
            slope = signs[i] * (weights[at] @ values + bias) - 1.0
            now = min(max(dual[i] - slope / norms[i], 0.0), cost[i])
            if step := (now - dual[i]) * signs[i]:
                weights[at] += step * values
                bias += step
                moved = max(moved, abs(step))
                dual[i] = now
        if moved < 1e-3:
            break
    return weights, bias
