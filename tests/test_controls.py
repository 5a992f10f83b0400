"""Invariants of the solvers, the sampler and the whole selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorfield.operators import controls, importance, solvers, sums
from mirrorfield.plans import selection


def ar(p, rho):
    return rho ** np.abs(np.subtract.outer(np.arange(p), np.arange(p)))


@pytest.mark.parametrize("method", ["equi", "sdp", "mvr", "maxent", "sdp_ccd"])
@pytest.mark.parametrize("m", [1, 5])
def test_feasible(method, m):
    sigma = ar(30, 0.4)
    s = solvers.solve_s(sigma, method, m)
    assert (s >= 0).all() and (s <= 1 + 1e-9).all() or method in ("mvr", "maxent")
    assert np.linalg.eigvalsh((m + 1) / m * sigma - np.diag(s))[0] > -1e-8


def test_maxent_and_mvr_are_stationary():
    sigma = ar(20, 0.5)
    for method, m in (("maxent", 1), ("mvr", 2)):
        s = solvers.solve_s(sigma, method, m, tol=1e-10)
        rest = np.linalg.inv((m + 1) / m * sigma - np.diag(s))
        gradient = 1 / s - np.diag(rest) if method == "maxent" else m * m / s**2 - np.diag(rest @ rest)
        assert np.abs(gradient).max() < 1e-4


@pytest.mark.parametrize("method", ["equi", "maxent", "mvr", "sdp"])
def test_groups(method):
    groups = np.repeat(np.arange(4), 3)
    sigma = np.where(groups[:, None] == groups, 0.4, 0.08) + 0.6 * np.eye(12)
    s = solvers.solve_s_group(sigma, groups, method, m=2)
    assert (s[groups[:, None] != groups] == 0).all()
    assert np.linalg.eigvalsh(s)[0] > -1e-7 and np.linalg.eigvalsh(1.5 * sigma - s)[0] > -1e-7


def test_singletons_are_ungrouped():
    assert np.allclose(np.diag(solvers.solve_s_group(ar(8, 0.3), np.arange(8), "maxent")), solvers.solve_s(ar(8, 0.3), "maxent"))


def frame(spark, x, y=None):
    rows = [(i, [float(v) for v in r], float(0 if y is None else y[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, y double")


def test_sampled_covariance(spark):
    rng = np.random.default_rng(0)
    sigma, n, m = ar(6, 0.4), 20_000, 2
    rows = frame(spark, rng.multivariate_normal(np.zeros(6), sigma, n))
    made = controls.gaussian(rows.repartition(7), "maxent", np.zeros(6), sigma, m)
    got = made.rows.orderBy("row_id").collect()
    both = np.array([[*r.x, *r.xko] for r in got])
    d = np.diag(made.s)
    theory = np.block([[sigma if i == j else sigma - d for j in range(m + 1)] for i in range(m + 1)])
    assert np.abs(np.cov(both.T) - theory).max() < 0.06
    again = controls.gaussian(rows.coalesce(2), "maxent", np.zeros(6), sigma, m).rows.orderBy("row_id").collect()
    assert np.allclose(both, [[*r.x, *r.xko] for r in again])


@pytest.mark.parametrize("held", [0, 1 << 27])
@pytest.mark.parametrize("mean", [0.0, 1.0, 10.0, 1e6])
def test_moments_do_not_hang_on_the_mean(spark, monkeypatch, mean, held):
    monkeypatch.setattr(sums, "HELD", held)
    rng = np.random.default_rng(7)
    sigma = 0.5 + 0.5 * np.eye(5)
    x = rng.multivariate_normal(np.full(5, mean), sigma, 4000)
    found = controls.moments(frame(spark, x).repartition(100))
    y = x - x.mean(0)
    assert found.n == 4000 and np.allclose(found.mean, x.mean(0)) and np.allclose(found.covariance(), np.cov(x.T), atol=1e-8)
    assert np.allclose(found.fourth, (y * y).T @ (y * y), rtol=1e-6) and np.abs(found.shrunk() - sigma).max() < 0.05
    assert np.allclose(found.gram, x.T @ x, rtol=1e-9)


@pytest.mark.parametrize("held", [0, 1 << 27])
def test_array_sums_add_up(spark, monkeypatch, held):
    monkeypatch.setattr(sums, "HELD", held)

    def part(batch):
        v = batch.column(0).to_numpy()
        return {int(k): np.array([v[v % 3 == k].sum(), 1.0]) for k in np.unique(v % 3)}

    got = sums.array_sums(spark.range(1000).repartition(90), part, 1)
    assert {k: g[0] for k, g in got.items()} == {k: float(sum(range(k, 1000, 3))) for k in range(3)}
    assert sums.array_sums(spark.range(0), part, 1) == {}


def test_rows_stay_on_the_cluster(spark, monkeypatch):
    """The driver takes rows only if they are few, or fewer than the partial sums."""
    rows = spark.range(1 << 20).select(F.array_repeat(F.col("id").cast("double"), 4).alias("x"))
    taken = []
    to_arrow = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: taken.append(self) or to_arrow(self))
    found = controls.moments(rows)
    assert found.n == 1 << 20 and np.allclose(found.mean, ((1 << 20) - 1) / 2) and not taken
    assert controls.moments(rows.limit(1000)).n == 1000 and len(taken) == 1
    # ten megabytes of rows, whose eight partial sums would be 13
    wide = frame(spark, np.ones((100, 260))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50))))
    assert controls.moments(wide).n == 5000 and len(taken) == 2
    both = rows.select(F.monotonically_increasing_id().alias("row_id"), "x", F.col("x").alias("xko"), F.get("x", F.lit(0)).alias("y"))
    assert sum(g[0, 0] for g in importance.fold_grams(both)) == 1 << 20 and len(taken) == 2


def test_selection_finds_signal(spark):
    rng = np.random.default_rng(3)
    n, p = 600, 40
    x = rng.multivariate_normal(np.zeros(p), ar(p, 0.3), n)
    beta = np.zeros(p)
    beta[::4] = 1.0
    out = selection.fit_lasso(frame(spark, x, x @ beta + rng.standard_normal(n)), fdrs=[0.2])
    found = {r.feature_id for r in out.selected.collect()}
    assert len(found & set(range(0, p, 4))) >= 8
    fit = out.beta.collect()[0]
    assert np.abs(np.array(fit.beta)[sorted(found)] - beta[sorted(found)]).max() < 0.3


def test_lasso_path_is_optimal():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 120))
    x[:, 7] = x[:, 3]
    y = x[:, :4].sum(1) + 0.3 * rng.standard_normal(80)
    x = (x - x.mean(0)) / x.std(0)
    c, r = x.T @ x / 80, x.T @ (y - y.mean()) / 80
    path = importance._Lasso(c, r)
    for lam in np.abs(r).max() * np.geomspace(1, 0.02, 25):
        b = path.step(lam)
        grad = r - c @ b
        assert np.abs(grad).max() <= lam * (1 + 1e-5)
        assert np.abs(grad[b != 0] - lam * np.sign(b[b != 0])).max(initial=0) < 1e-5 * max(1, lam)


def test_logistic_selection(spark):
    rng = np.random.default_rng(11)
    n, p = 1500, 30
    x = rng.multivariate_normal(np.zeros(p), ar(p, 0.3), n)
    beta = np.zeros(p)
    beta[::3] = rng.choice([-1.5, 1.5], 10)
    y = (rng.random(n) < 1 / (1 + np.exp(0.5 - x @ beta))).astype(float)
    out = selection.fit_lasso(frame(spark, x, y).repartition(20), fdrs=[0.2], family="binomial", debias="ls")
    found = {r.feature_id for r in out.selected.collect()}
    assert len(found & set(range(0, p, 3))) >= 8 and len(found - set(range(0, p, 3))) <= 3
    fit = out.beta.collect()[0]
    a = np.c_[np.ones(n), x[:, sorted(found)]]
    b = np.r_[fit.a0, np.array(fit.beta)[sorted(found)]]
    assert np.abs(a.T @ (y - 1 / (1 + np.exp(-a @ b)))).max() < 1e-4 * n  # the score equations hold
    with pytest.raises(ValueError):
        selection.fit_lasso(out.scores, family="poisson")


def test_factor_controls(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3)) @ rng.standard_normal((3, 20)) + 0.3 * rng.standard_normal((400, 20))
    assert controls.factors(np.linalg.eigvalsh(x.T @ x)[::-1], "er", 400) == 3
    assert controls.factor(frame(spark, x), "gr").count() == 400


def test_false_discoveries_on_average():
    """The rate holds for the mean over data sets, not for each: one draw may have twice as many."""
    n, p, shares = 600, 40, []
    beta = np.zeros(p)
    beta[::4] = 1.0
    for seed in range(16):
        rng = np.random.default_rng(seed)
        x = rng.multivariate_normal(np.zeros(p), ar(p, 0.3), n)
        y = x @ beta + rng.standard_normal(n)
        found = controls.Moments.of(x)
        sigma = found.shrunk()
        s = np.diag(solvers.solve_s(sigma, "maxent"))
        pull = np.linalg.solve(sigma, s)
        xko = x - (x - found.mean) @ pull + rng.standard_normal((n, p)) @ controls._root(2 * s - s @ pull).T
        a, fold = np.c_[np.ones(n), x, xko, y], rng.integers(0, 10, n)
        b = importance.cross_validated([a[fold == k].T @ a[fold == k] for k in range(10)]).beta
        w = np.abs(b[:p]) - np.abs(b[p:])
        fits = [t for t in np.abs(w[w != 0]) if 1 + (w <= -t).sum() <= 0.2 * (w >= t).sum()]
        chosen = np.flatnonzero(w >= min(fits, default=np.inf))
        shares.append((chosen % 4 != 0).sum() / max(1, len(chosen)))
    assert np.mean(shares) < 0.2 + 3 * np.std(shares) / 4


GROUPS = np.repeat(np.arange(6), 3)


@pytest.mark.parametrize("method", ["sdp_subopt", "maxent_block", "mvr_block", "sdp_block"])
@pytest.mark.parametrize("m", [1, 4])
def test_group_blocks_feasible(method, m):
    sigma = ar(18, 0.6)
    s = solvers.solve_s_group(sigma, GROUPS, method, m)
    assert np.array_equal(s, solvers.block_diagonal(s, GROUPS))
    assert np.linalg.eigvalsh(s)[0] > -1e-9
    assert np.linalg.eigvalsh((m + 1) / m * sigma - s)[0] > -1e-6


@pytest.mark.parametrize("m", [1, 4])
@pytest.mark.parametrize("method", ["maxent", "mvr"])
def test_blocks_reach_the_same_optimum(method, m):
    sigma = ar(18, 0.6)
    top = (m + 1) / m * sigma
    whole = solvers.solve_s_group(sigma, GROUPS, method, m, niter=400, tol=1e-9)
    blocks = solvers.solve_s_group(sigma, GROUPS, method + "_block", m, niter=400, tol=1e-7)
    a, b = (solvers._objective(top, s, sigma, m, method) for s in (whole, blocks))
    assert b == pytest.approx(a, rel=1e-4, abs=1e-3)


def test_subopt_beats_one_factor():
    sigma = ar(18, 0.6)
    sigma[:9, 9:] = sigma[9:, :9] = 0
    gain = np.trace(solvers.group_subopt(sigma, GROUPS)) - np.trace(solvers.group_equi(sigma, GROUPS))
    assert gain > -1e-6


def test_single_sdp():
    block = ar(4, 0.7)
    assert np.allclose(solvers.single_sdp(block, 2 * block), block, atol=1e-4)
    for upper in (0.5 * block, np.diag([0.5, 1.0, 2.0, 0.3])):
        s = solvers.single_sdp(block, upper)
        assert np.linalg.eigvalsh(upper - s)[0] > -1e-9
        rivals = [t * upper for t in np.linspace(0, 1, 21)]
        assert np.abs(block - s).sum() <= min(np.abs(block - r).sum() for r in rivals) + 1e-3


def test_debiased_lasso():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 6))
    y = 1 + x[:, 0] - 2 * x[:, 3] + 0.1 * rng.standard_normal(500)
    a, fold = np.c_[np.ones(500), x, y], rng.integers(0, 5, 500)
    grams = [a[fold == k].T @ a[fold == k] for k in range(5)]
    fit = importance.debiased_lasso(grams, np.array([0, 3, 4]))
    assert fit.beta[[1, 2, 5]].tolist() == [0, 0, 0]
    assert fit.beta[[0, 3]] == pytest.approx([1, -2], abs=0.1)
    assert importance.debiased_lasso(grams, np.array([], int)).intercept == pytest.approx(y.mean())


def test_residual_controls(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (7, 60)).astype(float)
    rows = [(j, [None if j == 2 and i == 0 else float(v) for i, v in enumerate(r)]) for j, r in enumerate(g)]
    df = spark.createDataFrame(rows, "variant_id long, g array<double>")
    got = controls.residual(df, 4, seed=5).orderBy("variant_id").collect()
    assert [r.variant_id for r in got] == list(range(7))
    assert got[2].g[0] == pytest.approx(g[2, 1:].mean())
    again = controls.residual(df.repartition(3), 4, seed=5).orderBy("variant_id").collect()
    assert np.allclose([r.gko for r in got], [r.gko for r in again])
    x, k = np.array([r.g for r in got]), np.array([r.gko for r in got])
    for j in range(7):
        first = j // 4 * 4
        others = [i for i in range(first, min(first + 4, 7)) if i != j]
        design = np.vstack([np.ones(60), x[others], k[first:j]]).T
        fit = design @ np.linalg.lstsq(design, x[j], rcond=None)[0]
        assert np.allclose(np.sort(k[j] - fit), np.sort(x[j] - fit))
    assert controls.residual(df.limit(0), 4).count() == 0
