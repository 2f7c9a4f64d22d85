"""Soft clusters of a few hundred vectors: reduction, Gaussian mixtures, choice of their number. Small helpers in numpy."""

from __future__ import annotations

import numpy as np

RIDGE = 1e-6


def reduced(x: np.ndarray) -> np.ndarray:
    """Normalised vectors on at most five principal axes (signs fixed); tiny sets stay as they are."""
    n, d = x.shape
    if n <= 3 or d <= 3:
        return x
    v = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    v = v - v.mean(axis=0)
    _, _, axes = np.linalg.svd(v, full_matrices=False)
    axes = axes[: max(2, min(5, n - 2, d))]
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    return v @ axes.T


def _log_densities(x: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covariances, strict=True)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, k] = -0.5 * ((z * z).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
    return out


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Nearest of k centres, each drawn far from those before it and then moved to the middle of its points."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack((centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]))
    for _ in range(10):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
    return np.eye(k)[near]


def mixture(x: np.ndarray, k: int, seed: int, steps: int = 100) -> tuple[np.ndarray, float]:
    """(probabilities of each component, log likelihood) of a mixture of k Gaussians with full covariances."""
    resp = _start(x, k, np.random.default_rng(seed))
    d, before = x.shape[1], -np.inf
    for _ in range(steps):
        mass = resp.sum(axis=0) + 1e-12
        means = (resp.T @ x) / mass[:, None]
        covariances = np.array([(resp[:, j, None] * (x - means[j])).T @ (x - means[j]) / mass[j] + RIDGE * np.eye(d) for j in range(k)])
        logs = _log_densities(x, means, covariances) + np.log(mass / mass.sum())
        total = np.logaddexp.reduce(logs, axis=1)
        resp = np.exp(logs - total[:, None])
        if abs(total.mean() - before) < 1e-3:
            break
        before = total.mean()
    return resp, float(total.sum())


def bic(log_likelihood: float, k: int, n: int, d: int) -> float:
    """Bayesian information criterion of k Gaussians with full covariances in d dimensions."""
    return -2 * log_likelihood + (k - 1 + k * d + k * d * (d + 1) // 2) * np.log(n)


def soft_clusters(vectors: np.ndarray, most: int = 20, threshold: float = 0.1, seed: int = 42) -> list[list[int]]:
    """Members of each cluster. A vector belongs to each cluster of at least that probability, else to its likeliest."""
    n = len(vectors)
    if n <= 2:
        return [list(range(n))] if n else []
    x = reduced(np.asarray(vectors, float))
    fits = [mixture(x, k, seed) for k in range(1, max(1, min(most, n // 2)) + 1)]
    best = int(np.argmin([bic(ll, k, n, x.shape[1]) for k, (_, ll) in enumerate(fits, 1)]))
    p = fits[best][0]
    member = p >= threshold
    member[np.arange(n)[~member.any(axis=1)], p[~member.any(axis=1)].argmax(axis=1)] = True
    return [np.flatnonzero(m).tolist() for m in member.T if m.any()]
