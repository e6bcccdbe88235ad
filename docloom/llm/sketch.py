"""SetSketch: registers of exponentially spaced, truncated minima (Ertl, 2021), over batches of sets.

A register holds floor(1 - log_base x) for the smallest x among exponential values that the elements of a set are
hashed to, cut off to 0..LIMIT. The registers of a union are the maxima of the registers, so sketches merge.
Equal registers become likelier with the Jaccard similarity, which makes bands of registers usable as bucket keys.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 200
ROWS = 5  # registers in a band; 40 bands find a pair of similarity 0.8 but for 1 in 8 million
BASE = 1.2
RATE = 20.0
LIMIT = 255
PRUNE = 9.0  # log-likelihood: a pair just at the threshold is dropped once in 90,000, one of 0.85 next to never
_POWERS = BASE ** -np.arange(LIMIT + 2, dtype=np.float64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sketch(elements: np.ndarray, owner: np.ndarray, sets: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (sets x m, uint8) of sets given as flat 64-bit element hashes and the set each belongs to.

    Each element draws an ascending sequence of points of a Poisson process, each for a random register; it stops
    once its point is too large to change any register of its set.
    """
    registers = np.zeros(sets * m, np.uint8)
    low = np.zeros(sets, np.uint8)
    h, own, x, step = elements.astype(np.uint64), owner, np.zeros(len(elements)), 0
    while len(h):
        step += 1
        r = mix(h + _U(step * 0x9E3779B97F4A7C15 % 2**64))
        u = ((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (RATE * m)
        live = x <= _POWERS[low[own]]
        h, own, x, r = h[live], own[live], x[live], r[live]
        level = np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, LIMIT).astype(np.uint8)
        slot = own * m + (mix(r ^ _U(0xD6E8FEB86659FD93)) % _U(m)).astype(np.int64)
        np.maximum.at(registers, slot, level)
        if step < 8 or step % 8 == 0:
            low = registers.reshape(sets, m).min(axis=1) if sets else low
    return registers.reshape(sets, m)


def _likelihood(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, m: int):
    """The joint log-likelihood of a Jaccard similarity, given in how many registers U is more and less than V, and the set sizes."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def at(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + (m - more - less) * np.log(np.maximum(1 - a - b, 1e-12))

    return at


def estimate(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The similarity of maximum likelihood, by golden-section search (the likelihood is concave)."""
    at, ratio = _likelihood(more, less, n_u, n_v, m), (5**0.5 - 1) / 2
    low, high = np.zeros(len(more)), np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    for _ in range(25):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        right = at(a) < at(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def plausible(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, threshold: float, m: int = REGISTERS, prune: float = PRUNE) -> np.ndarray:
    """Whether no similarity below the threshold is likelier than the threshold itself by more than ``prune``."""
    at = _likelihood(more, less, n_u, n_v, m)
    here = at(np.float64(threshold))
    good = np.minimum(n_u, n_v) >= (threshold - 1e-9) * np.maximum(n_u, n_v)
    for j in np.linspace(0.0, threshold, 10, endpoint=False)[4:]:
        good &= at(j) <= here + prune
    return good


def equal(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many registers each of many sketches equals one; eight registers are compared and summed in a word."""
    pad = -many.shape[1] % 8
    same = (many == one).view(np.uint8)
    same = np.ascontiguousarray(np.pad(same, ((0, 0), (0, pad))) if pad else same).view(np.uint64)
    total = np.zeros(len(many), np.int64)
    for at in range(0, same.shape[1], 31):  # a byte holds up to 255
        part = same[:, at : at + 31].sum(axis=1, dtype=np.uint64)
        total += sum((part >> _U(8 * i)) & _U(255) for i in range(8)).astype(np.int64)
    return total


def least_equal(threshold: float, m: int = REGISTERS, prune: float = PRUNE) -> int:
    """Fewer equal registers than this are implausible at the threshold, whatever the set sizes: a bound that costs less than the likelihood.

    Registers of sets at the threshold are equal with that probability or more; the bound is Hoeffding's, exp(-2 t * t / m).
    """
    return max(0, int(threshold * m - (prune * m / 2) ** 0.5))
