"""Importance by lasso from Gram matrices: linear models read the rows once, logistic ones once a round; penalties are solved on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorfield.operators.sums import array_sums

FAMILIES = ("gaussian", "binomial")


@dataclass
class Fit:
    intercept: float
    beta: np.ndarray
    penalty: float


def _table(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """[1, x, xko] and y of (fold, x, xko, y)."""
    n = batch.num_rows
    flat = lambda i: batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.c_[np.ones(n), flat(1), flat(2)], batch.column(3).to_numpy(zero_copy_only=False)


def _by_fold(rows: DataFrame, folds: int, part: Callable[[np.ndarray, np.ndarray, int], np.ndarray], size: Callable[[int], int] = lambda width: 0) -> list[np.ndarray | None]:
    """For each fold the sum of what part makes of its rows' tables, y and number: about size numbers, for a width of [x, xko]. A row's fold is a hash of its row_id."""

    def run(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        a, y = _table(batch)
        fold = batch.column(0).to_numpy()
        return {int(k): part(a[fold == k], y[fold == k], int(k)) for k in np.unique(fold)}

    cut = rows.select(F.pmod(F.xxhash64("row_id"), F.lit(folds)).cast("int").alias("fold"), *[F.col(c).cast("array<double>").alias(c) for c in ("x", "xko")], F.col("y").cast("double").alias("y"))
    width = rows.select(F.size("x") + F.size("xko")).first()
    found = array_sums(cut, run, width[0], folds * size(width[0])) if width else {}
    return [found.get(k) for k in range(folds)]


def _square(g: np.ndarray) -> np.ndarray:
    size = int(np.sqrt(len(g)))
    return g.reshape(size, size)


def fold_grams(rows: DataFrame, folds: int = 10) -> list[np.ndarray]:
    """For each fold the Gram matrix of [1, x, xko, y]; zeros for a fold without rows."""
    found = _by_fold(rows, folds, lambda a, y, _: ((t := np.c_[a, y]).T @ t).ravel(), lambda width: (width + 2) ** 2)
    size = max(len(g) for g in found if g is not None)
    return [_square(np.zeros(size) if g is None else g) for g in found]


def _standard(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Correlations of the columns, with y, and what standardised them."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 1e-300))
    return cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd, mean[:-1], sd, float(mean[-1])


class _Lasso:
    """Minimises b' c b / 2 - r' b + lam |b| for descending lam, warm-started: on an active set, by accelerated proximal steps,
    and exactly as soon as their signs are right."""

    def __init__(self, c: np.ndarray, r: np.ndarray):
        self.c, self.r, self.b, self.grad = c, r, np.zeros(len(r)), r.copy()

    def step(self, lam: float) -> np.ndarray:
        for _ in range(50):
            active = np.flatnonzero((self.b != 0) | (np.abs(self.grad) > lam))
            if not len(active):
                break
            rows = self.c[active]
            found = self._on(rows[:, active], self.r[active], lam, self.b[active])
            self.b = np.zeros(len(self.r))
            self.b[active] = found
            self.grad = self.r - found @ rows
            if not np.any((self.b == 0) & (np.abs(self.grad) > lam * (1 + 1e-6) + 1e-10)):
                break
        return self.b

    @staticmethod
    def _exact(c: np.ndarray, r: np.ndarray, lam: float, b: np.ndarray) -> np.ndarray | None:
        """The solution with b's signs, if there is one."""
        on = np.flatnonzero(b)
        out = np.zeros(len(b))
        if len(on):
            signs = np.sign(b[on])
            try:
                out[on] = np.linalg.solve(c[np.ix_(on, on)], r[on] - lam * signs)
            except np.linalg.LinAlgError:
                return None
            if not np.array_equal(np.sign(out[on]), signs):
                return None
        return out if np.abs((r - c @ out)[b == 0]).max(initial=0) <= lam * (1 + 1e-9) + 1e-12 else None

    def _on(self, c: np.ndarray, r: np.ndarray, lam: float, b: np.ndarray, most: int = 2000) -> np.ndarray:
        v = np.ones(len(r))
        for _ in range(12):
            v = c @ v
            v /= max(np.linalg.norm(v), 1e-300)
        top = 1.05 * float(v @ c @ v) + 1e-12
        y, t = b, 1.0
        for k in range(most):
            z = y + (r - c @ y) / top
            new = np.sign(z) * np.maximum(np.abs(z) - lam / top, 0)
            if (y - new) @ (new - b) > 0:
                t = 1.0
            ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
            move = new - b
            y, t, b = new + (t - 1) / ahead * move, ahead, new
            done = np.abs(move).max() < 1e-10
            if (k % 25 == 24 or done) and (sure := self._exact(c, r, lam, b)) is not None:
                return sure
            if done:
                break
            if not np.isfinite(b).all():
                raise FloatingPointError("the lasso's steps diverge")
        return b


def cross_validated(grams: list[np.ndarray], n_penalties: int = 60, ratio: float = 1e-2, patience: int = 8, seed: int = 1) -> Fit:
    """Lasso at the penalty of the least mean squared error over the folds; the first on ties.

    Columns are solved in a seeded random order, so that no original is favoured before its copies. Penalties go down until
    the error has not fallen for patience of them.
    """
    size = len(grams[0])
    order = np.random.default_rng(seed).permutation(size - 2)
    at = np.r_[0, 1 + order, size - 1]
    grams = [g[np.ix_(at, at)] for g in grams]
    whole = sum(grams)
    c, r, mean, sd, y_mean = _standard(whole)
    top = float(np.abs(r).max(initial=0))
    if top == 0:
        return Fit(y_mean, np.zeros(len(r)), 0.0)
    penalties = top * np.geomspace(1, ratio, n_penalties)
    folds = [(g, *_standard(whole - g)) for g in grams if 0 < g[0, 0] < whole[0, 0]]
    paths, loss = [_Lasso(f[1], f[2]) for f in folds], []
    for lam in penalties:
        error = 0.0
        for (g, _, _, m, s, y), path in zip(folds, paths):
            b = path.step(lam) / s
            on = np.flatnonzero(b)
            full, where = np.r_[y - b @ m, b[on], -1.0], np.r_[0, 1 + on, size - 1]
            error += full @ g[np.ix_(where, where)] @ full
        loss.append(error)
        if len(loss) - 1 - int(np.argmin(loss)) >= patience:
            break
    best = int(np.argmin(loss))
    path = _Lasso(c, r)
    for lam in penalties[: best + 1]:
        solved = path.step(lam)
    beta = np.zeros(len(r))
    beta[order] = solved / sd
    return Fit(float(y_mean - solved / sd @ mean), beta, float(penalties[best]))


def _logistic(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -30, 30)))


def _weighted_gram(rows: DataFrame, fit: Fit, at: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of [1, x, xko, z] under the weights of a logistic model at fit, z its working response; at: of these columns only."""
    coefficients = np.r_[fit.intercept, fit.beta]
    columns = np.arange(len(coefficients)) if at is None else np.r_[0, 1 + at]

    def part(a: np.ndarray, y: np.ndarray, _: int) -> np.ndarray:
        eta = a @ coefficients
        p = _logistic(eta)
        w = np.maximum(p * (1 - p), 1e-5)
        t = np.c_[a[:, columns], eta + (y - p) / w] * np.sqrt(w)[:, None]
        return (t.T @ t).ravel()

    return _square(_by_fold(rows, 1, part, lambda width: (len(columns) + 1) ** 2)[0])


def cross_validated_logistic(rows: DataFrame, folds: int = 10, n_penalties: int = 60, ratio: float = 1e-2, rounds: int = 4, seed: int = 1) -> Fit:
    """Logistic lasso of y = 0 or 1 on [x, xko].

    The path of each fold is that of the model linearised at its mean, from one pass of Gram matrices; a second pass gives the
    held-out deviances of all paths; at the best penalty, rounds of weighted Gram matrices lead to the logistic fit itself.
    """
    grams = fold_grams(rows, folds)
    size = len(grams[0])
    order = np.random.default_rng(seed).permutation(size - 2)
    whole = sum(grams)
    _, r, _, sd, y_mean = _standard(whole)
    if not 0 < y_mean < 1 or not np.abs(r).max(initial=0):
        return Fit(float(np.log((y_mean + 1e-12) / (1 - y_mean + 1e-12))), np.zeros(size - 2), 0.0)
    penalties = float(np.abs(r).max()) * np.geomspace(1, ratio, n_penalties)
    paths = []
    for g in grams:
        part = whole - g if 0 < g[0, 0] < whole[0, 0] else whole
        c, r_f, mean, s, y = _standard(part)
        path = _Lasso(c[np.ix_(order, order)], r_f[order])
        lines = np.zeros((n_penalties, size - 1))
        for k, lam in enumerate(penalties):
            lines[k, 1 + order] = path.step(lam) / s[order] / max(y * (1 - y), 1e-5)
        lines[:, 0] = np.log(y / (1 - y)) - lines[:, 1:] @ mean if 0 < y < 1 else 0
        paths.append(lines)
    shared = rows.sparkSession.sparkContext.broadcast(paths)

    def deviance(a: np.ndarray, y: np.ndarray, fold: int) -> np.ndarray:
        eta = np.clip(a @ shared.value[fold].T, -30, 30)
        return (np.log1p(np.exp(eta)) - y[:, None] * eta).sum(0)

    loss = sum(d for d in _by_fold(rows, folds, deviance) if d is not None)
    lam = float(penalties[int(np.argmin(loss))])
    fit = Fit(float(np.log(y_mean / (1 - y_mean))), np.zeros(size - 2), lam)
    for _ in range(rounds):
        g = _weighted_gram(rows, fit)
        n, total = whole[0, 0], g[0, 0]
        mean = g[0, 1:] / total
        cov = (g[1:, 1:] - total * np.outer(mean, mean)) / n
        path = _Lasso((cov[:-1, :-1] / np.outer(sd, sd))[np.ix_(order, order)], (cov[:-1, -1] / sd)[order])
        for step in penalties[penalties >= lam]:
            solved = path.step(step)
        beta = np.zeros(size - 2)
        beta[order] = solved / sd[order]
        fit = Fit(float(mean[-1] - beta @ mean[:-1]), beta, lam)
    return fit


def debiased_logistic(rows: DataFrame, support: np.ndarray, rounds: int = 8) -> Fit:
    """Logistic regression with intercept on the support only, by weighted least squares; a round reads the rows once."""
    support = np.asarray(support, int)
    width = rows.select(F.size("x") + F.size("xko")).first()[0]
    fit = Fit(0.0, np.zeros(width), 0.0)
    for _ in range(rounds):
        g = _weighted_gram(rows, fit, support)
        solved = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
        beta = np.zeros(width)
        beta[support] = solved[1:]
        moved = np.abs(beta - fit.beta).max(initial=0)
        fit = Fit(float(solved[0]), beta, 0.0)
        if moved < 1e-8:
            break
    return fit


def debiased(gram: np.ndarray, support: np.ndarray) -> Fit:
    """Least squares with intercept on the support only."""
    at = np.r_[0, 1 + np.asarray(support, int)]
    solved = np.linalg.lstsq(gram[np.ix_(at, at)], gram[at, -1], rcond=None)[0]
    beta = np.zeros(len(gram) - 2)
    beta[support] = solved[1:]
    return Fit(float(solved[0]), beta, 0.0)


def debiased_lasso(grams: list[np.ndarray], support: np.ndarray) -> Fit:
    """Cross-validated lasso on the support only, from the Gram matrices of the folds; zeros stay zero. No support: the mean of y."""
    at = np.r_[0, 1 + np.asarray(support, int), len(grams[0]) - 1]
    beta = np.zeros(len(grams[0]) - 2)
    if len(at) == 2:
        whole = sum(grams)
        return Fit(float(whole[0, -1] / whole[0, 0]), beta, 0.0)
    found = cross_validated([g[np.ix_(at, at)] for g in grams])
    beta[support] = found.beta
    return Fit(found.intercept, beta, found.penalty)
