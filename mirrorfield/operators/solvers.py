"""Solvers for s: how far each control copy may lie from its feature. Dense p x p algebra on the driver.

All maximise over s >= 0 with (m + 1) / m Sigma - diag(s) positive semidefinite. The coordinate solvers keep the inverse of
that matrix up to date by rank-one corrections and rebuild it after each sweep.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def check_correlation(sigma: np.ndarray) -> None:
    if not np.allclose(sigma, sigma.T, rtol=1e-9, atol=1e-12):
        raise ValueError("not symmetric")
    if not np.allclose(np.diag(sigma), 1):
        raise ValueError("not a correlation matrix")


def to_correlation(sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = np.sqrt(np.diag(sigma))
    return sigma / np.outer(sd, sd), sd


def until_positive(sigma: np.ndarray, tol: float = 1e-4) -> np.ndarray:
    """sigma with as many steps of tol on its diagonal as its smallest eigenvalue needs to exceed tol."""
    short = tol - np.linalg.eigvalsh(sigma)[0]
    return sigma if short < 0 else sigma + np.eye(len(sigma)) * tol * (np.floor(short / tol) + 1)


def equi(sigma: np.ndarray, m: int = 1) -> np.ndarray:
    return np.full(len(sigma), min(1.0, (m + 1) / m * max(np.linalg.eigvalsh(sigma)[0], 0.0)))


def _sweep(top: np.ndarray, s: np.ndarray, step: Callable[[float, float, float], float], block: int = 64) -> float:
    """One step for each coordinate, in order; the largest one. step(s_j, v_j, |v|^2) is of column v of the inverse of top - diag(s).

    Within a block of coordinates only the block's part of the inverse, and of its square, is kept up to date; the whole
    follows once a block, by one product of matrices.
    """
    inverse, worst = np.linalg.inv(top - np.diag(s)), 0.0
    for lo in range(0, len(s), block):
        own = np.arange(lo, min(lo + block, len(s)))
        columns = inverse[:, own]
        start = columns[own]
        k, square, before = start.copy(), columns.T @ columns, s[own].copy()
        for a, j in enumerate(own):
            # s + move must leave the matrix positive: move < 1 / k_aa
            move = min(max(step(s[j], k[a, a], square[a, a]), -s[j] + 1e-10), (1 - 1e-6) / k[a, a])
            if move:
                alpha, row, of = move / (1 - move * k[a, a]), k[a].copy(), square[a].copy()
                cross = np.outer(alpha * row, of + alpha / 2 * of[a] * row)
                square += cross + cross.T
                k += alpha * np.outer(row, row)
                s[j] += move
                worst = max(worst, abs(move))
        moved = np.diag(s[own] - before)
        inverse += columns @ np.linalg.solve(np.eye(len(own)) - moved @ start, moved) @ columns.T
    return worst


def _descend(sigma: np.ndarray, m: int, step: Callable[[float, float, float], float], niter: int, tol: float) -> np.ndarray:
    top, s = (m + 1) / m * sigma, 0.5 * equi(sigma, m)
    for _ in range(niter):
        if _sweep(top, s, step) < tol:
            break
    return s


def maxent(sigma: np.ndarray, m: int = 1, niter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Maximises logdet((m + 1) / m Sigma - diag(s)) + logdet(diag(s)): each coordinate's optimum is in closed form."""
    # with c = 1 / v_j the matrix's determinant is proportional to c - move, so s + move = c - move
    return _descend(sigma, m, lambda s, v, _: (1 / v - s) / 2, niter, tol)


def mvr(sigma: np.ndarray, m: int = 1, niter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Minimises m^2 tr(diag(s)^-1) + tr(((m + 1) / m Sigma - diag(s))^-1)."""

    def step(s: float, v: float, square: float) -> float:
        # derivative: -m^2 / (s + x)^2 + |v|^2 / (1 - x v_j)^2 = 0, the root between the poles
        b = np.sqrt(square)
        return (m - b * s) / (b + m * v)

    return _descend(sigma, m, step, niter, tol)


def sdp_ccd(sigma: np.ndarray, m: int = 1, lam: float = 0.5, mu: float = 0.8, niter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Maximises sum(s), s <= 1, by a logarithmic barrier whose weight shrinks each sweep."""
    top, s = (m + 1) / m * sigma, 0.5 * equi(sigma, m)
    for weight in lam * mu ** np.arange(niter):
        _sweep(top, s, lambda s, v, _: min(1.0, max(0.0, s + 1 / v - weight)) - s)
        if weight < tol:
            break
    return s


def solve_s(sigma: np.ndarray, method: str | Callable = "maxent", m: int = 1, **options) -> np.ndarray:
    """s on the scale of sigma's variances; method: equi, sdp, mvr, maxent, sdp_ccd or a function of (correlation, m, **options)."""
    if m < 1:
        raise ValueError("m must be at least 1")
    if not np.allclose(sigma, sigma.T, rtol=1e-9, atol=1e-12):
        raise ValueError("not symmetric")
    cor, sd = to_correlation(np.asarray(sigma, np.float64))
    solvers = {"equi": equi, "maxent": maxent, "mvr": mvr, "sdp_ccd": sdp_ccd, "sdp": lambda c, m, **o: sdp_ccd(c, m, **({"niter": 200, "tol": 1e-9} | o))}
    solver = method if callable(method) else solvers[method]
    return np.clip(solver(cor, m, **options), 0, None) * sd**2


def block_diagonal(sigma: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return np.where(groups[:, None] == groups[None, :], sigma, 0.0)


def group_equi(sigma: np.ndarray, groups: np.ndarray, m: int = 1) -> np.ndarray:
    """gamma times the block diagonal, gamma as large as 1 and positivity allow."""
    d = block_diagonal(sigma, groups)
    w, u = np.linalg.eigh(d)
    half = (u / np.sqrt(np.maximum(w, 1e-6))) @ u.T
    return min(1.0, (m + 1) / m * max(np.linalg.eigvalsh(half @ sigma @ half)[0], 0.0)) * d


def group_subopt(sigma: np.ndarray, groups: np.ndarray, m: int = 1, lam: float = 0.5, mu: float = 0.8, niter: int = 60) -> np.ndarray:
    """Each group's block of sigma times a gamma in [0, 1]: the largest sum of group size times gamma that positivity allows.

    Coordinate ascent under a logarithmic barrier whose weight shrinks each sweep.
    """
    top = (m + 1) / m * sigma
    s = 0.5 * group_equi(sigma, groups, m)
    blocks = []
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        w, u = np.linalg.eigh(sigma[np.ix_(at, at)])
        blocks.append((at, u * np.sqrt(np.maximum(w, 0))))
    for weight in lam * mu ** np.arange(niter):
        for at, root in blocks:
            own = np.ix_(at, at)
            gamma = s[at[0], at[0]] / sigma[at[0], at[0]]
            # move t changes the barrier by weight * sum log(1 - t v)
            v = np.linalg.eigvalsh(root.T @ np.linalg.inv(top - s)[own] @ root)
            low, high = -gamma, min(1 - gamma, (1 - 1e-9) / v[-1])
            for _ in range(60):
                t = (low + high) / 2
                low, high = (t, high) if len(at) > weight * (v / (1 - t * v)).sum() else (low, t)
            s[own] = (gamma + low) * sigma[own]
    return s


def single_sdp(block: np.ndarray, upper: np.ndarray, niter: int = 300, tol: float = 1e-7, start: np.ndarray | None = None, within: np.ndarray | None = None, bounded: bool = False) -> np.ndarray:
    """The S closest to block in sum of absolute differences with S and upper - S positive semidefinite: splitting into the three parts, averaged.

    within: where S may differ from 0, so that several blocks are solved at once; bounded: entries lie in [0, 1].
    """
    if len(block) == 1:
        return np.clip(block, 0, upper)
    mask = np.ones_like(block) if within is None else within

    def near_block(a: np.ndarray) -> np.ndarray:
        out = block + np.sign(a - block) * np.maximum(np.abs(a - block) - 0.1, 0)
        return (np.clip(out, 0, 1) if bounded else out) * mask

    z = np.zeros_like(block) if start is None else start.copy()
    duals = [np.zeros_like(block) for _ in range(3)]
    parts = (near_block, _positive, lambda a: upper - _positive(upper - a))
    for _ in range(niter):
        near = [f(z - d) for f, d in zip(parts, duals)]
        new = sum(x + d for x, d in zip(near, duals)) / 3 * mask
        duals = [d + x - new for x, d in zip(near, duals)]
        done, z = np.abs(new - z).max() < tol, new
        if done and max(np.abs(x - z).max() for x in near) < 100 * tol:
            break
    return _within(z, upper)


def group_sdp_whole(sigma: np.ndarray, groups: np.ndarray, m: int = 1, bounded: bool = False, niter: int = 2000, tol: float = 1e-7) -> np.ndarray:
    """All blocks at once: the block-diagonal S closest to sigma's blocks in sum of absolute differences that positivity allows."""
    mask = (groups[:, None] == groups).astype(float)
    return single_sdp(sigma * mask, (1 - 1e-6) * (m + 1) / m * sigma, niter, tol, group_equi(sigma, groups, m), mask, bounded)


def _positive(a: np.ndarray) -> np.ndarray:
    w, u = np.linalg.eigh((a + a.T) / 2)
    return (u * np.maximum(w, 0)) @ u.T


def _within(s: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """s made positive semidefinite and scaled until upper - s is, too."""
    s = _positive(s)
    half = np.linalg.inv(np.linalg.cholesky(upper))
    return s / max(1.0, np.linalg.eigvalsh(half @ s @ half.T)[-1])


def single_mvr(upper: np.ndarray, weight: np.ndarray, start: np.ndarray, m: int = 1, niter: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Minimises m^2 tr(S^-1) + tr(weight (upper - S)^-1) by descent along S G S, G the gradient, with halved steps."""

    def value(s: np.ndarray) -> float:
        if min(np.linalg.eigvalsh(s)[0], np.linalg.eigvalsh(upper - s)[0]) <= 0:
            return np.inf
        return m * m * np.trace(np.linalg.inv(s)) + np.trace(weight @ np.linalg.inv(upper - s))

    s, size = start, 1.0
    now = value(s)
    for _ in range(niter):
        back, rest = np.linalg.inv(s), np.linalg.inv(upper - s)
        way = s @ (rest @ weight @ rest - m * m * back @ back) @ s
        way = (way + way.T) / 2
        size *= 4
        while size > 1e-14 and not (then := value(s - size * way)) < now:
            size /= 2
        if size <= 1e-14:
            break
        s, before, now = s - size * way, now, then
        if before - now < tol * abs(now):
            break
    return s


def group_blocks(sigma: np.ndarray, groups: np.ndarray, method: str, m: int = 1, niter: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Block descent: each group's block is solved whole, the others held; upper is the Schur complement it must stay below.

    method: maxent_block (in closed form), mvr_block or sdp_block.
    """
    top = (m + 1) / m * sigma
    s = 0.5 * group_equi(sigma, groups, m) + 1e-8 * np.eye(len(sigma))
    members = [np.flatnonzero(groups == g) for g in np.unique(groups)]
    for _ in range(niter):
        worst = 0.0
        for at in members:
            own, rest = np.ix_(at, at), np.flatnonzero(~np.isin(np.arange(len(sigma)), at))
            d = top - s
            into = np.linalg.solve(d[np.ix_(rest, rest)] + 1e-8 * np.eye(len(rest)), d[np.ix_(rest, at)])
            upper = top[own] - d[np.ix_(at, rest)] @ into
            upper = (upper + upper.T) / 2
            if method == "maxent_block":
                new = m / (m + 1) * upper
            elif method == "mvr_block":
                new = single_mvr(upper, np.eye(len(at)) + into.T @ into, s[own], m)
            elif method == "sdp_block":
                new = single_sdp(sigma[own], (1 - 1e-6) * upper, 100, 1e-5, s[own])
            else:
                raise ValueError("method must be maxent_block, mvr_block or sdp_block")
            worst = max(worst, np.abs(new - s[own]).max())
            s[own] = new
        if worst < tol:
            break
    return s


def _objective(top: np.ndarray, s: np.ndarray, sigma: np.ndarray, m: int, method: str) -> float:
    rest = top - s
    if method == "maxent":
        return -np.linalg.slogdet(rest)[1] - m * np.linalg.slogdet(s)[1]
    if method == "mvr":
        return m * m * np.trace(np.linalg.inv(s)) + np.trace(np.linalg.inv(rest))
    return float(np.abs(sigma - s)[s != 0].sum())


def group_block_objective(sigma: np.ndarray, s: np.ndarray, groups, m: int, method: str) -> float:
    """sdp: the groups' mean absolute differences of sigma and s, summed; maxent and mvr: what the solvers of that name optimise."""
    groups = np.asarray(groups)
    if method.startswith("sdp"):
        return sum(block_difference(sigma[np.ix_(at, at)], s[np.ix_(at, at)]) for at in (np.flatnonzero(groups == g) for g in np.unique(groups)))
    top, s = (m + 1) / m * sigma, s + (1e-8 * np.eye(len(s)) if method.startswith("maxent") else 0)
    return -_objective(top, s, sigma, m, "maxent") if method.startswith("maxent") else _objective(top, s, sigma, m, "mvr")


def block_difference(block: np.ndarray, s: np.ndarray) -> float:
    """Mean absolute difference of the entries."""
    return float(np.abs(block - s).mean())


def maxent_of_roots(rest: np.ndarray, own: np.ndarray, m: int) -> float:
    """logdet((m + 1) / m Sigma - S) + m logdet(S), from the Cholesky factors of both."""
    return 2 * float(np.log(np.diag(rest)).sum() + m * np.log(np.diag(own)).sum())


def mvr_of_roots(rest: np.ndarray, own: np.ndarray, m: int) -> float:
    """m^2 tr(S^-1) + tr(((m + 1) / m Sigma - S)^-1), from the Cholesky factors of both."""
    inverse = lambda a: float((np.linalg.inv(a) ** 2).sum())
    return m * m * inverse(own) + inverse(rest)


def solve_s_group(sigma: np.ndarray, groups, method: str = "maxent", m: int = 1, niter: int = 100, tol: float = 1e-4) -> np.ndarray:
    """S, zero between groups, for equi, maxent, mvr, sdp, sdp_subopt, maxent_block, mvr_block, sdp_block, or all blocks at once for
    sdp_subopt_correct and, with entries in [0, 1], sdp_full; on the scale of sigma.

    maxent and mvr: coordinate ascent along the directions v v', v the eigenvectors of the groups' blocks, unit vectors
    and pairs within groups; both inverses follow by rank-one corrections. sdp: the same moves, each as large as the objective and positivity let it.
    Groups of one each are the ungrouped problem.
    """
    groups = np.asarray(groups)
    sigma = np.asarray(sigma, np.float64)
    if len(groups) != len(sigma):
        raise ValueError("a group for each feature is needed")
    if not np.allclose(sigma, sigma.T, rtol=1e-9, atol=1e-12):
        raise ValueError("not symmetric")
    if len(np.unique(groups)) == len(groups):
        return np.diag(solve_s(sigma, "sdp_ccd" if method.startswith("sdp") else method.removesuffix("_block"), m))
    cor, sd = to_correlation(sigma)
    scale = np.outer(sd, sd)
    if method == "equi":
        return group_equi(cor, groups, m) * scale
    if method == "sdp_subopt":
        return group_subopt(cor, groups, m) * scale
    if method in ("sdp_subopt_correct", "sdp_full"):
        return group_sdp_whole(cor, groups, m, method == "sdp_full") * scale
    if method.endswith("_block"):
        return group_blocks(cor, groups, method, m, niter, tol) * scale
    top = (m + 1) / m * cor
    s = 0.5 * group_equi(cor, groups, m) + 1e-8 * np.eye(len(cor))
    directions = []
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        for v in np.linalg.eigh(cor[np.ix_(at, at)])[1].T if len(at) > 1 else []:
            directions.append((at, v))
        directions += [(np.array([j]), np.ones(1)) for j in at]
        directions += [(np.array([i, j]), np.array([1.0, sign]) / np.sqrt(2)) for a, i in enumerate(at) for j in at[a + 1 :] for sign in (1, -1)]
    before = _objective(top, s, cor, m, method)
    for _ in range(niter):
        inv_s, inv_r = np.linalg.inv(s), np.linalg.inv(top - s)
        for at, v in directions:
            ps, pr = inv_s[:, at] @ v, inv_r[:, at] @ v
            a, b = float(v @ ps[at]), float(v @ pr[at])  # move in (-1 / a, 1 / b)
            if method == "maxent":
                move = (m * a - b) / ((m + 1) * a * b)
            elif method == "mvr":
                x, y = m * np.sqrt(ps @ ps), np.sqrt(pr @ pr)
                move = (x - y) / (x * b + y * a)
            else:
                gap = (cor - s)[np.ix_(at, at)]
                vv = np.outer(v, v)
                kinks = np.array([0.0, *(gap[np.abs(vv) > 1e-9] / vv[np.abs(vv) > 1e-9])])
                kinks = np.clip(kinks, -0.999 / a, 0.999 / b)
                move = float(min(kinks, key=lambda k: np.abs(gap - k * vv).sum()))
            move = min(max(move, -0.999 / a), 0.999 / b)
            if abs(move) < 1e-14:
                continue
            s[np.ix_(at, at)] += move * np.outer(v, v)
            inv_s -= (move / (1 + move * a)) * np.outer(ps, ps)
            inv_r += (move / (1 - move * b)) * np.outer(pr, pr)
        now = _objective(top, s, cor, m, method)
        if before - now < tol:
            break
        before = now
    return s * scale
