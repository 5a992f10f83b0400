"""Groups of correlated features, their representatives, and S from the representatives."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from mirrorfield.operators import solvers

LINKAGES = ("single", "average", "complete", "ward", "ward_presquared")


def _numbered(labels: np.ndarray) -> np.ndarray:
    """0, 1, ... in order of first appearance."""
    first: dict[int, int] = {}
    return np.array([first.setdefault(int(x), len(first)) for x in labels])


def _update(linkage: str, x: np.ndarray, y: np.ndarray, d: float, i: int, j: int, size: np.ndarray) -> np.ndarray:
    if linkage == "single":
        return np.minimum(x, y)
    if linkage == "complete":
        return np.maximum(x, y)
    if linkage == "average":
        return (size[i] * x + size[j] * y) / (size[i] + size[j])
    ward = linkage == "ward"
    x, y, d = (x * x, y * y, d * d) if ward else (x, y, d)
    new = ((size[i] + size) * x + (size[j] + size) * y - size * d) / (size[i] + size[j] + size)
    return np.sqrt(np.maximum(new, 0)) if ward else new


def partition(sigma: np.ndarray, cutoff: float = 0.5, min_clusters: int = 1, linkage: str = "complete", contiguous: bool = False) -> np.ndarray:
    """A group for each feature: clusters at distance 1 - |correlation|, merged while they are at most 1 - cutoff apart.

    contiguous: single linkage where a merge takes in all that lies between. Ties go to the first pair. p x p on the driver.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    if not 0 <= cutoff <= 1:
        raise ValueError("cutoff must lie in [0, 1]")
    away = 1 - np.abs(solvers.to_correlation(np.asarray(sigma, np.float64))[0])
    np.fill_diagonal(away, np.inf)
    if contiguous:
        return _contiguous(away, 1 - cutoff, min_clusters)
    p = len(away)
    label, size = np.arange(p), np.ones(p)
    for _ in range(p - max(min_clusters, 1)):
        i, j = sorted(divmod(int(np.argmin(away)), p))
        if away[i, j] > 1 - cutoff:
            break
        new = _update(linkage, away[i], away[j], away[i, j], i, j, size)
        new[[i, j]] = np.inf
        away[i], away[:, i] = new, new
        away[j], away[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return _numbered(label)


def _contiguous(away: np.ndarray, height: float, min_clusters: int) -> np.ndarray:
    bounds = [(k, k + 1) for k in range(len(away))]
    while len(bounds) > max(min_clusters, 1):
        i, j = sorted(divmod(int(np.argmin(away)), len(bounds)))
        if away[i, j] > height or len(bounds) - (j - i) < min_clusters:
            break
        bounds[i : j + 1] = [(bounds[i][0], bounds[j][1])]
        joined = away[i : j + 1].min(0)
        near = np.r_[joined[:i], np.inf, joined[j + 1 :]]
        keep = np.r_[0 : i + 1, j + 1 : len(away)]
        away = away[np.ix_(keep, keep)]
        away[i], away[:, i] = near, near
    return np.repeat(np.arange(len(bounds)), [b - a for a, b in bounds])


def prioritised(index: Sequence[int], first: Sequence[int]) -> list[int]:
    """index with the members of first leading, in first's order; the others keep theirs."""
    known = set(index)
    lead = [i for i in first if i in known]
    return lead + [i for i in index if i not in set(lead)]


def greedy_order(c: np.ndarray, tol: float = 1e-12) -> list[int]:
    """Columns in the order in which each leaves the least residual variance; those that add nothing come last, as they stand."""
    c, order, left = c.copy(), [], list(range(len(c)))
    while left:
        gain = [float((c[:, j] ** 2).sum() / c[j, j]) if c[j, j] > tol else -1.0 for j in left]
        j = left[int(np.argmax(gain))]
        if max(gain) < 0:
            return order + left
        order.append(j)
        left.remove(j)
        c = c - np.outer(c[:, j], c[:, j]) / c[j, j]
    return order


def _explained(sigma: np.ndarray, by: list[int], of: list[int]) -> np.ndarray:
    if not by:
        return np.zeros(len(of))
    a = sigma[np.ix_(by, of)]
    return (a * (np.linalg.pinv(sigma[np.ix_(by, by)], hermitian=True) @ a)).sum(0) / sigma[of, of]


def smallest_prefix(sigma: np.ndarray, order: Sequence[int], target: float = 0.25) -> int:
    """How many of the first features in order leave each other one a residual variance of target or less."""
    order = list(order)
    for k in range(1, len(order)):
        rest = order[k:]
        if (sigma[rest, rest] * (1 - _explained(sigma, order[:k], rest))).max() <= target:
            return k
    return len(order)


def representatives(sigma: np.ndarray, groups, threshold: float = 0.5, first: Sequence[int] = ()) -> list[int]:
    """Features that stand for their groups, ascending.

    Per group in greedy order, those in first leading: members are added until the rest is explained by them to the share
    threshold of what they and all outside explain. Members that are linear in others come last in the greedy order.
    """
    groups, out = np.asarray(groups), []
    for g in dict.fromkeys(groups.tolist()):
        at = np.flatnonzero(groups == g).tolist()
        outside = np.flatnonzero(groups != g).tolist()
        order = prioritised([at[i] for i in greedy_order(sigma[np.ix_(at, at)])], first)
        chosen = order[:1]
        for j in order[1:]:
            rest = [i for i in order if i not in chosen]
            share = _explained(sigma, chosen, rest) / np.maximum(_explained(sigma, sorted(chosen + outside), rest), 1e-300)
            if share.mean() > threshold:
                break
            chosen.append(j)
        out += chosen
    return sorted(out)


def conditionally_independent(sigma: np.ndarray, groups, reps: Sequence[int]) -> np.ndarray:
    """sigma as if, given its group's representatives, every other feature were independent of the other groups."""
    groups, reps = np.asarray(groups), np.asarray(reps)
    pull, rest = np.zeros((len(sigma), len(reps))), np.zeros_like(sigma)
    for g in np.unique(groups):
        at, mine = np.flatnonzero(groups == g), np.flatnonzero(groups[reps] == g)
        r = reps[mine]
        b = np.linalg.solve(sigma[np.ix_(r, r)], sigma[np.ix_(r, at)]).T
        pull[np.ix_(at, mine)] = b
        rest[np.ix_(at, at)] = sigma[np.ix_(at, at)] - b @ sigma[np.ix_(r, at)]
    out = pull @ sigma[np.ix_(reps, reps)] @ pull.T + rest
    return (out + out.T) / 2


def solve_by_representatives(sigma: np.ndarray, groups, reps: Sequence[int], method: str = "maxent", m: int = 1, **options) -> tuple[np.ndarray, np.ndarray]:
    """(S of the representatives, dense D of all): the others follow from their regression on the representatives."""
    groups, reps = np.asarray(groups), np.asarray(reps)
    among = sigma[np.ix_(reps, reps)]
    s = solvers.solve_s_group(among, groups[reps], method, m, **options)
    pull = np.linalg.solve(among, sigma[reps]).T
    d = pull @ s @ pull.T + sigma - pull @ sigma[reps]
    d = np.where(np.abs(d) < 1e-10, 0.0, (d + d.T) / 2)
    return s, d
