"""Covariances to simulate from."""

from __future__ import annotations

import numpy as np

from mirrorfield.operators.solvers import to_correlation


def ar1(p: int, a: float = 1, b: float = 1, max_corr: float = 1, rho: float | None = None, tol: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Correlations that are products of neighbours' correlations: all rho, or drawn from Beta(a, b), at most max_corr."""
    near = np.full(p - 1, rho) if rho is not None else np.clip(np.random.default_rng(seed).beta(a, b, p - 1), 1e-300, max_corr)
    far = np.r_[0.0, np.cumsum(np.log(near))]
    sigma = np.exp(-np.abs(far[:, None] - far))
    least = np.linalg.eigvalsh(sigma)[0]
    return sigma if least >= tol else to_correlation(sigma + (tol - least) * np.eye(p))[0]


def erdos_renyi(p: int, share: float = 0.1, low: float = 0.3, high: float = 0.9, least: float = 0.1, blocksize: int = 10, invert: bool = False, seed: int = 1) -> np.ndarray:
    """Block-diagonal correlations with random entries of size low to high, either sign; invert: of the inverse matrix."""
    rng, sigma = np.random.default_rng(seed), np.eye(p)
    for at in range(0, p, blocksize):
        n = min(blocksize, p - at)
        block = np.triu(rng.uniform(low, high, (n, n)) * rng.choice([-1, 1], (n, n)) * (rng.random((n, n)) < share), 1)
        block += block.T + np.eye(n)
        short = least - np.linalg.eigvalsh(block)[0]
        sigma[at : at + n, at : at + n] = block + max(short, 0) * np.eye(n)
    return to_correlation(np.linalg.inv(sigma) if invert else sigma)[0]


def blocks(groups, within: float, between: float, factors: int = 0, weight: float = 1, seed: int = 1) -> np.ndarray:
    """Correlation within between members of a group, within * between across groups, plus random factors, scaled back."""
    groups = np.asarray(groups)
    sigma = np.where(groups[:, None] == groups, within, within * between)
    np.fill_diagonal(sigma, 1.0)
    if factors:
        v = np.random.default_rng(seed).standard_normal((len(groups), factors))
        sigma = to_correlation(sigma + weight * v @ v.T)[0]
    return sigma
