"""A Voronoi partition of vectors and what a ball around one can meet of it."""

from __future__ import annotations

import numpy as np


def centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Means of about k parts of a sample, from random rows; empty parts are dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(float)
    for _ in range(rounds):
        a = owners(x, c)
        n = np.bincount(a, minlength=len(c))
        c = (np.stack([np.bincount(a, v, minlength=len(c)) for v in x.T], 1) / np.maximum(n, 1)[:, None])[n > 0]
    return c


def owners(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of every row."""
    half = (c**2).sum(1) / 2
    return np.concatenate([np.zeros(0, int), *(np.argmin(half - x[i : i + 4_096] @ c.T, 1) for i in range(0, len(x), 4_096))])


def met(x: np.ndarray, c: np.ndarray, own: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
    """Per row the parts, other than its own, that may hold a vector within its radius.

    Such a vector lies beyond the plane half way between the row's own centroid and that of its part, so
    the part counts only if this plane is within the radius.
    """
    sq, gaps = (c**2).sum(1), np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 0))
    out = []
    for i in range(0, len(x), 1_024):
        d = sq - 2 * x[i : i + 1_024] @ c.T
        o = own[i : i + 1_024]
        near = d - d[np.arange(len(o)), o][:, None] <= 2 * radius[i : i + 1_024, None] * gaps[o] * (1 + 1e-9) + 1e-6
        near[np.arange(len(o)), o] = False
        out += [np.nonzero(r)[0].astype(np.int32) for r in near]
    return out
