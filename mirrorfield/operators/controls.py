"""Control copies of numeric features: moments on the cluster, small algebra on the driver, sampling where the rows lie.

Rows are (row_id, x array<double>). Noise is seeded by (seed, row_id), so neither partitioning nor retries change it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfield.operators import grouping, solvers
from mirrorfield.operators.sums import array_sums
from mirrorfield.sources import plink


@dataclass
class Moments:
    """Sums over n rows of x less its mean: products of pairs, and products of pairs of squares."""

    n: int
    mean: np.ndarray
    centred: np.ndarray
    fourth: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        return cls.shifted(len(x), np.zeros(x.shape[1]), *_sums(x))

    @classmethod
    def shifted(cls, n: int, shift: np.ndarray, s: np.ndarray, g: np.ndarray, t: np.ndarray, f: np.ndarray) -> Moments:
        """From the sums of y, y y', (y y) y' and (y y) (y y)', y = x - shift, entry by entry."""
        d, square = s / n, np.diag(g)
        centred = g - n * np.outer(d, d)
        one = -2 * d * t + np.outer(square, d**2) - 2 * np.outer(d * s, d**2)
        fourth = f + one + one.T + 4 * np.outer(d, d) * g + n * np.outer(d**2, d**2)
        return cls(n, shift + d, centred, fourth)

    @property
    def gram(self) -> np.ndarray:
        """Sums of products of x itself."""
        return self.centred + self.n * np.outer(self.mean, self.mean)

    def covariance(self) -> np.ndarray:
        return self.centred / max(self.n - 1, 1)

    def shrunk(self) -> np.ndarray:
        """Covariance shrunk linearly to its diagonal, by the estimated share of sampling noise in the off-diagonal entries."""
        s, n = self.covariance(), self.n
        noise = np.maximum(self.fourth / n - (self.centred / n) ** 2, 0) / max(n - 1, 1)
        off = ~np.eye(len(s), dtype=bool)
        share = min(1.0, max(0.0, noise[off].sum() / max((s[off] ** 2).sum(), 1e-300)))
        return np.where(off, (1 - share) * s, s)


def _sums(x: np.ndarray) -> list[np.ndarray]:
    return [x.sum(0), x.T @ x, (x * x).T @ x, (x * x).T @ (x * x)]


def _array(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def moments(rows: DataFrame) -> Moments:
    """One pass over x, less the mean of some rows, so that sums of large values don't cancel; the rest of the mean is taken off the sums."""
    some = rows.select(F.col("x").cast("array<double>").alias("x")).limit(64).collect()
    if not some:
        raise ValueError("no rows")
    shift = np.mean([r.x for r in some], axis=0)
    p = len(shift)

    def part(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        y = _array(batch) - shift
        return {0: np.concatenate([[len(y)], *[a.ravel() for a in _sums(y)]])}

    total = array_sums(rows.select("x"), part, p, p + 3 * p * p)[0]
    s, g, t, f = np.split(total[1:], np.cumsum([p, p * p, p * p]))
    return Moments.shifted(int(total[0]), shift, s, *[a.reshape(p, p) for a in (g, t, f)])


def _noise(ids: np.ndarray, seed: int, width: int) -> np.ndarray:
    return np.stack([np.random.default_rng([seed, int(i) & (2**63 - 1)]).standard_normal(width) for i in ids]) if len(ids) else np.empty((0, width))


def _root(v: np.ndarray) -> np.ndarray:
    """A with A A' = v, v positive semidefinite up to rounding."""
    w, u = np.linalg.eigh((v + v.T) / 2)
    return u * np.sqrt(np.maximum(w, 0))


def _law(sigma: np.ndarray, s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sigma^-1 S, and roots of the parts of the copies' covariance that they share and that is each one's own."""
    s = np.diag(s) if s.ndim == 1 else s
    pull = np.linalg.solve(sigma, s)
    c = 2 * s - s @ pull
    return pull, _root(c - (m - 1) / m * s), _root(s)


def _drawn(x: np.ndarray, e: np.ndarray, mean: np.ndarray, pull: np.ndarray, common: np.ndarray, apart: np.ndarray, m: int) -> np.ndarray:
    """rows x m x p copies from noise e, rows x (m + 1) p."""
    n, p = x.shape
    centre = x - (x - mean) @ pull + e[:, :p] @ common.T
    own = e[:, p:].reshape(n, m, p) if m > 1 else np.zeros((n, 1, p))
    return centre[:, None, :] + (own - own.mean(1, keepdims=True)) @ apart.T


def condition(rows: DataFrame, mean: np.ndarray, sigma: np.ndarray, s: np.ndarray, m: int = 1, seed: int = 1) -> DataFrame:
    """rows (row_id, x) or (row_id, x, y) with xko array<double>: m copies, one block of p after the other, drawn given x.

    The copies are N(x - (x - mean) Sigma^-1 S, C) with covariance C - S between copies, C = 2 S - S Sigma^-1 S. They are
    sampled without the mp x mp matrix: one shared part of covariance C - (m - 1) / m S, and centred parts of covariance S.
    """
    pull, common, apart = _law(sigma, s, m)
    p = len(mean)
    shared = rows.sparkSession.sparkContext.broadcast((mean, pull, common, apart))
    more = ["y"] if "y" in rows.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, pull, common, apart = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _array(batch, 1)
            copies = _drawn(x, _noise(ids, seed, p * (m + 1)), mean, pull, common, apart, m)
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (m * p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(copies.ravel())), *batch.columns[2:]], ["row_id", "x", "xko", *more])

    cut = rows.select("row_id", F.col("x").cast("array<double>").alias("x"), *[F.col(c).cast("double").alias(c) for c in more])
    return cut.mapInArrow(run, "row_id long, x array<double>, xko array<double>" + "".join(f", {c} double" for c in more))


@dataclass
class Controls:
    rows: DataFrame
    mean: np.ndarray
    sigma: np.ndarray
    s: np.ndarray
    m: int


def gaussian(rows: DataFrame, method: str = "maxent", mean: np.ndarray | None = None, sigma: np.ndarray | None = None, m: int = 1, seed: int = 1, groups=None, covariance: Callable[[Moments], np.ndarray] = Moments.shrunk, **options) -> Controls:
    """Model-X controls; without mean and sigma they are estimated (second order), sigma by covariance. groups: one label per feature, for group controls."""
    if mean is None or sigma is None:
        found = moments(rows)
        mean, sigma = found.mean, covariance(found)
    s = solvers.solve_s(sigma, method, m, **options) if groups is None else solvers.solve_s_group(sigma, groups, method, m, **options)
    return Controls(condition(rows, mean, sigma, s, m, seed), mean, sigma, s, m)


def window_ranges(p: int, windowsize: int) -> list[range]:
    """Windows of neighbouring features, the last one maybe smaller."""
    if windowsize <= 1:
        raise ValueError("windowsize must exceed 1")
    return [range(a, min(a + windowsize, p)) for a in range(0, p, windowsize)]


@dataclass
class WindowedControls:
    """rows, and per window its range, mean, covariance and s: nothing is as large as all features squared."""

    rows: DataFrame
    windows: list[tuple[range, np.ndarray, np.ndarray, np.ndarray]]
    m: int


def windowed(rows: DataFrame, windowsize: int = 500, method: str = "maxent", m: int = 1, seed: int = 1, ranges: list[range] | None = None) -> WindowedControls:
    """Model-X controls of a covariance that is block-diagonal in windows of neighbouring features; ranges may be uneven but must cover all in order.

    Moments are summed per window, s is solved per window, copies are drawn per window; for a block-diagonal covariance the
    windows' bounds are the bound of the whole.
    """
    some = rows.select(F.col("x").cast("array<double>").alias("x")).limit(64).collect()
    if not some:
        raise ValueError("no rows")
    shift = np.mean([r.x for r in some], axis=0)
    p = len(shift)
    ranges = window_ranges(p, windowsize) if ranges is None else ranges
    if [j for r in ranges for j in r] != list(range(p)):
        raise ValueError("the windows must cover all features")

    def part(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        y = _array(batch) - shift
        return {k: np.concatenate([[len(y)], *[a.ravel() for a in _sums(y[:, r.start : r.stop])]]) for k, r in enumerate(ranges)}

    totals, windows, draws = array_sums(rows.select("x"), part, p, sum(len(r) + 3 * len(r) ** 2 for r in ranges)), [], []
    for k, r in enumerate(ranges):
        w = len(r)
        own, g, t, f = np.split(totals[k][1:], np.cumsum([w, w * w, w * w]))
        found = Moments.shifted(int(totals[k][0]), shift[r.start : r.stop], own, *[a.reshape(w, w) for a in (g, t, f)])
        sigma = found.shrunk()
        s = solvers.solve_s(sigma, method, m)
        windows.append((r, found.mean, sigma, s))
        draws.append((r, found.mean, *_law(sigma, s, m)))
    shared = rows.sparkSession.sparkContext.broadcast(draws)
    more = ["y"] if "y" in rows.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, e = _array(batch, 1), _noise(batch.column(0).to_numpy(), seed, p * (m + 1))
            copies = np.empty((len(x), m, p))
            at = 0
            for r, mean, pull, common, apart in shared.value:
                w = len(r)
                copies[:, :, r.start : r.stop] = _drawn(x[:, r.start : r.stop], e[:, at : at + w * (m + 1)], mean, pull, common, apart, m)
                at += w * (m + 1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (m * p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(copies.ravel())), *batch.columns[2:]], ["row_id", "x", "xko", *more])

    cut = rows.select("row_id", F.col("x").cast("array<double>").alias("x"), *[F.col(c).cast("double").alias(c) for c in more])
    return WindowedControls(cut.mapInArrow(run, "row_id long, x array<double>, xko array<double>" + "".join(f", {c} double" for c in more)), windows, m)


def factor(rows: DataFrame, rule: str = "er", seed: int = 1, m: int = 1) -> DataFrame:
    """m controls of a factor model x = F L' + e: the rank-r part of x plus fresh noise of the residual variances.

    r by eigenvalue ratio (er), growth ratio (gr) or 90 % of the variance (ve).
    """
    found = moments(rows)
    values, vectors = np.linalg.eigh(found.gram)
    values, vectors = values[::-1], vectors[:, ::-1]
    r = factors(values, rule, found.n)
    load = vectors[:, :r]
    keep = np.eye(len(values)) - load @ load.T
    sums = found.n * found.mean
    var = (np.einsum("ij,jk,ki->i", keep, found.gram, keep) - (keep @ sums) ** 2 / found.n) / max(found.n - 1, 1)
    shared = rows.sparkSession.sparkContext.broadcast((load @ load.T, np.sqrt(np.maximum(var, 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sd = shared.value
        for batch in batches:
            x = _array(batch, 1)
            noise = _noise(batch.column(0).to_numpy(), seed, m * len(sd)).reshape(len(x), m, len(sd))
            out = (x @ part)[:, None, :] + noise * sd
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (m * len(sd)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["row_id", "x", "xko"])

    return rows.select("row_id", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "row_id long, x array<double>, xko array<double>")


def factors(values: np.ndarray, rule: str, n: int) -> int:
    """How many factors descending eigenvalues show."""
    positive = values[values > max(values[0], 0) * 1e-12][: max(n, 1)]
    if rule == "ve":
        return int(np.argmax(np.cumsum(positive) / positive.sum() > 0.9)) + 1
    most = max(len(positive) - 2, 1)
    if rule == "er":
        return int(np.argmax(positive[: most - 1] / positive[1:most])) + 1 if most > 1 else 1
    if rule != "gr":
        raise ValueError("rule must be er, gr or ve")
    tails = np.r_[np.cumsum(positive[::-1])[::-1][1:], 1e-300]
    growth = np.log1p(positive / tails)
    return int(np.argmax(growth[: most - 1] / growth[1:most])) + 1 if most > 1 else 1


def summary(z: np.ndarray, d: np.ndarray, sigma_inverse: np.ndarray, m: int = 1, seed: int = 1) -> np.ndarray:
    """m control copies, one row each, of z-scores: (I - D Sigma^-1) z plus noise of covariance 2 D - D Sigma^-1 D."""
    p = len(z)
    e = np.random.default_rng(seed).standard_normal((m + 1, p))
    c = 2 * d - d @ sigma_inverse @ d
    own = (e[1:] - e[1:].mean(0)) @ _root(d).T
    return z - d @ sigma_inverse @ z + e[0] @ _root(c - (m - 1) / m * d).T + (own if m > 1 else 0)


def by_representatives(rows: DataFrame, groups, method: str = "maxent", threshold: float = 0.5, m: int = 1, seed: int = 1, enforce: bool = False) -> Controls:
    """Group controls whose S is solved on the groups' representatives and extended to all features.

    enforce: S is solved on the covariance that makes the rest independent given the representatives; x is still conditioned on sigma.
    """
    found = moments(rows)
    sigma = found.shrunk()
    reps = grouping.representatives(sigma, groups, threshold)
    used = grouping.conditionally_independent(sigma, groups, reps) if enforce else sigma
    d = grouping.solve_by_representatives(used, groups, reps, method, m)[1]
    return Controls(condition(rows, found.mean, sigma, d, m, seed), found.mean, sigma, d, m)


def fixed(rows: DataFrame, method: str = "maxent", seed: int = 1) -> Controls:
    """Fixed-X controls: with U orthonormal and orthogonal to x, x (I - G^-1 D) + U C, C'C = 2 D - D G^-1 D, G = x'x.

    Columns are scaled to norm 1. Noise columns are summed along with x in one pass; what of them lies in x's span goes
    by the Gram matrix alone. At least twice as many rows as features are needed.
    """

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch, 1)
            both = np.hstack([x, _noise(batch.column(0).to_numpy(), seed, x.shape[1] if len(x) else 0)])
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * both.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(both.ravel()))], ["row_id", "x"])

    wide = rows.select("row_id", F.col("x").cast("array<double>").alias("x")).mapInArrow(widen, "row_id long, x array<double>")
    found = moments(wide)
    p = len(found.mean) // 2
    if found.n < 2 * p:
        raise ValueError("at least twice as many rows as features are needed")
    norm = np.sqrt(np.diag(found.gram)[:p])
    gram = found.gram[:p, :p] / np.outer(norm, norm)
    cross = found.gram[:p, p:] / norm[:, None]
    into = np.linalg.solve(gram, cross)
    rest = found.gram[p:, p:] - cross.T @ into
    s = solvers.solve_s(gram, method)
    d = np.diag(s)
    pull = np.linalg.solve(gram, d)
    turn = np.linalg.inv(np.linalg.cholesky((rest + rest.T) / 2)).T @ _root(2 * d - d @ pull).T
    shared = rows.sparkSession.sparkContext.broadcast((norm, pull + into @ turn, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, back, turn = shared.value
        for batch in batches:
            both = _array(batch, 1)
            x, noise = both[:, : len(norm)] / norm, both[:, len(norm) :]
            out = x - x @ back + noise @ turn
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(norm))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(offsets, pa.array(a.ravel())) for a in (x, out)]], ["row_id", "x", "xko"])

    return Controls(wide.mapInArrow(run, "row_id long, x array<double>, xko array<double>"), np.zeros(p), gram, s, 1)


def residual(variants: DataFrame, windowsize: int = 100, seed: int = 1) -> DataFrame:
    """(variant_id, g, gko) of (variant_id, g array<double>), g over the samples: per feature the fit on its window's others
    and on the copies made before it there, plus that fit's residuals in shuffled order.

    A window is windowsize neighbouring variant_ids and one task's work: two windowsize x samples matrices. Missing values
    count as the feature's mean, a feature without any value as 0. Shuffles are seeded by (seed, variant_id). No rows give no rows.
    """
    if windowsize <= 1:
        raise ValueError("windowsize must exceed 1")

    def run(window: pa.Table) -> pa.Table:
        window = window.sort_by("variant_id")
        ids = window.column("variant_id").to_pylist()
        x = np.array([[np.nan if v is None else v for v in g] for g in window.column("g").to_pylist()], np.float64).reshape(len(ids), -1)
        some = ~np.isnan(x)
        mean = np.where(some, x, 0).sum(1) / np.maximum(some.sum(1), 1)
        x = np.where(some, x, mean[:, None])
        n = x.shape[1]
        copies = np.empty_like(x)
        for j, key in enumerate(ids):
            design = np.vstack([np.ones((1, n)), np.delete(x, j, 0), copies[:j]]).T
            fit = design @ np.linalg.lstsq(design, x[j], rcond=None)[0]
            copies[j] = fit + np.random.default_rng([seed, key & (2**63 - 1)]).permutation(x[j] - fit)
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n)
        return pa.table([pa.array(ids, pa.int64()), *[pa.ListArray.from_arrays(offsets, pa.array(a.ravel())) for a in (x, copies)]], ["variant_id", "g", "gko"])

    rows = variants.select(F.col("variant_id").cast("long").alias("variant_id"), F.col("g").cast("array<double>").alias("g"), F.floor(F.col("variant_id") / windowsize).alias("window"))
    return rows.groupBy("window").applyInArrow(run, "variant_id long, g array<double>, gko array<double>")


def residual_of_files(spark: SparkSession, prefix: str, windowsize: int = 100, seed: int = 1) -> DataFrame:
    """residual for the genotypes of a .bed, .bim and .fam triple."""
    return residual(plink.read(spark, prefix), windowsize, seed)
