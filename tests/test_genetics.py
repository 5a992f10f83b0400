"""Chains, genotype files, groups and fixed designs: exact distributions, round trips, invariants."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorfield.functions import markov, simulate
from mirrorfield.operators import chains, controls, grouping, solvers
from mirrorfield.sources import plink


def model(p=3, k=2):
    rng = np.random.default_rng(5)
    return chains.Haplotypes(rng.uniform(0.2, 1, p), rng.dirichlet(np.ones(k), p), rng.uniform(0.1, 0.9, (p, k)))


def test_pair_index(spark):
    got = [(1, 5, 5), (2, 2, 6), (3, 3, 10), (5, 5, 15)]
    rows = spark.createDataFrame([g[:2] for g in got], "a int, b int")
    assert [r.i for r in rows.select(markov.pair_index(F.col("a"), F.col("b"), 5).alias("i")).collect()] == [g[2] for g in got]


def test_transitions_agree(spark):
    m = model(4, 3)
    h = spark.createDataFrame([(j, k, float(m.r[j]), float(m.alpha[j, k]), float(m.theta[j, k])) for j in range(4) for k in range(3)], "j int, k int, r double, alpha double, theta double")
    for r in markov.genotype_transitions(h).collect():
        at = lambda x, y: int(np.flatnonzero((m.a == x) & (m.b == y))[0])
        assert r.p == pytest.approx(m.step(r.j)[at(r.a, r.b), at(r.c, r.d)])
    assert all(np.allclose(m.step(j).sum(1), 1) for j in range(4))


def test_chain_controls_are_exchangeable():
    """The joint law of (z, control) stays when any of the variables are swapped."""
    rng = np.random.default_rng(1)
    steps, start, n = rng.dirichlet([2, 2], (3, 2)), np.array([0.4, 0.6]), 400_000
    z = chains.sample_chain(n, 3, start, lambda j: steps[j])
    out = chains.chain_controls(z, start, lambda j: steps[j], rng.random((n, 3)))
    for swap in itertools.product([0, 1], repeat=3):
        w = np.array(swap, bool)
        a, b = np.c_[z, out], np.c_[np.where(w, out, z), np.where(w, z, out)]
        count = lambda x: np.bincount(x @ (1 << np.arange(6)), minlength=64) / n
        assert np.abs(count(a) - count(b)).max() < 0.004


def test_states_follow_the_posterior():
    m, x = model(), np.array([[0, 2, -1]])
    chance = {}
    for path in itertools.product(range(3), repeat=3):
        p = m.start()[path[0]]
        for j, s in enumerate(path):
            p *= (m.step(j)[path[j - 1], s] if j else 1) * (m.emission(j)[x[0, j], s] if x[0, j] >= 0 else 1)
        chance[path] = p
    n = 100_000
    z = m.states(np.repeat(x, n, 0), np.random.default_rng(2).random((n, 3)))
    total = sum(chance.values())
    for path, p in chance.items():
        assert abs((z == path).all(1).mean() - p / total) < 0.008


def test_genotype_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    g = rng.integers(-1, 3, (11, 7))
    table = spark.createDataFrame([(i, [None if v < 0 else int(v) for v in r]) for i, r in enumerate(g)], "variant_id long, g array<tinyint>")
    bim = spark.createDataFrame([(i, "1", f"s{i}", 0.0, i * 10, "A", "C") for i in range(11)], "variant_id long, " + plink.BIM)
    fam = spark.createDataFrame([(i, "f", f"p{i}", "0", "0", 1, "-9") for i in range(7)], "sample_id long, " + plink.FAM)
    prefix = str(tmp_path / "x")
    plink.write(table, bim, fam, prefix, ".k")
    back = sorted((r.variant_id, r.g) for r in plink.read(spark, prefix, per_task=4).collect())
    assert [[-1 if v is None else v for v in r] for _, r in back] == g.tolist()
    assert [(r.variant_id, r.snp_id, r.pos) for r in plink.variants(spark, prefix).orderBy("variant_id").collect()] == [(i, f"s{i}.k", 10 * i) for i in range(11)]
    assert [(r.sample_id, r["sample"]) for r in plink.samples(spark, prefix).orderBy("sample_id").collect()] == [(i, f"p{i}") for i in range(7)]
    spark.dataSource.register(plink.Genotypes)
    loaded = spark.read.format("genotypes").option("perTask", 3).load(prefix)
    assert sorted((r.variant_id, r.g) for r in loaded.collect()) == back and loaded.rdd.getNumPartitions() == 4
    rows = plink.by_sample(plink.read(spark, prefix))
    assert plink.by_variant(rows).orderBy("variant_id").first().g == back[0][1]
    made = chains.genotypes(rows, model(11, 2))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, chains.genotypes(rows.repartition(3), model(11, 2)).collect()))


def test_standardised_in_arrays_and_in_rows(spark):
    """Long variants take a time in proportion; one sample, no spread and nothing known are as in SQL."""
    rng = np.random.default_rng(4)
    many = rng.integers(-1, 3, 20_000).tolist()
    odd = {0: many, 1: [None, 2, 0, -1, 1], 2: [1, 1, None], 3: [None, -1], 4: [2], 5: [None], None: [0, 2]}
    table = spark.createDataFrame(list(odd.items()), "variant_id long, g array<tinyint>")
    began = time.time()
    arrays = {r.variant_id: r.x for r in table.select("variant_id", plink.standardised(F.col("g")).alias("x")).collect()}
    assert time.time() - began < 30
    long = table.select("variant_id", F.posexplode("g").alias("sample_id", "g"))
    for by in (None, F.broadcast(plink.spread(long))):
        rows = {k: [None] * len(v) for k, v in odd.items()}
        found = plink.standardised_rows(long, by).collect()
        assert len(found) == sum(map(len, odd.values()))
        for r in found:
            rows[r.variant_id][r.sample_id] = r.x
        for k, g in odd.items():
            g = np.array([np.nan if v is None or v < 0 else v for v in g], float)
            known = g[~np.isnan(g)]
            x = np.where(np.isnan(g), 0, g - known.mean()) if len(known) else None
            want = [None] * len(g) if x is None else [np.nan] * len(g) if len(g) < 2 or not x.any() else x / x.std(ddof=1)
            for got in (arrays[k], rows[k]):
                assert [v is None for v in got] == [v is None for v in want]
                assert None in got or np.allclose(got, want, rtol=1e-12, equal_nan=True)


def test_from_files_to_files(spark, tmp_path):
    m, prefix = model(9, 2), str(tmp_path / "in")
    rows = spark.createDataFrame([(i, [(i + j) % 3 for j in range(9)]) for i in range(12)], "row_id long, x array<int>")
    bim = spark.createDataFrame([(i, "1", f"s{i}", 0.5, i, "A", "C") for i in range(9)], "variant_id long, " + plink.BIM)
    fam = spark.createDataFrame([(i, "f", f"p{i}", "0", "0", 1, "-9") for i in range(12)], "sample_id long, " + plink.FAM)
    plink.write(plink.by_variant(rows), bim, fam, prefix)
    chains.write_haplotypes(m, str(tmp_path / "model"))
    back = chains.read_haplotypes(spark, str(tmp_path / "model"))
    assert all(np.array_equal(getattr(back, k), getattr(m, k)) for k in ("r", "alpha", "theta"))
    made = chains.genotype_files(spark, prefix, str(tmp_path / "model"), str(tmp_path / "out"), seed=3)
    want = {r.row_id: r.xko for r in chains.genotypes(rows, m, seed=3).collect()}
    assert {r.row_id: r.xko for r in made.collect()} == want
    assert {r.row_id: r.x for r in plink.by_sample(plink.read(spark, str(tmp_path / "out"))).collect()} == want
    assert controls.residual_of_files(spark, prefix, 5).count() == 9


def test_small_functions(spark):
    rows = spark.range(1, 56).select(markov.index_pair(F.col("id"), 10).alias("p"), "id").select("id", "p.*")
    assert all(r.i == r.id for r in rows.select("id", markov.pair_index(F.col("a"), F.col("b"), 10).alias("i")).collect())
    g = spark.createDataFrame([(1, [0, None, -1, 2])], "variant_id long, g array<tinyint>")
    assert plink.without_missing(g).first().g == [0, 0, 0, 2]
    sigma = simulate.ar1(12, rho=0.9)
    k = grouping.smallest_prefix(sigma, [5, 0, 11, 2, 8, 1, 3, 4, 6, 7, 9, 10])
    left = lambda n: max(1 - grouping._explained(sigma, [5, 0, 11, 2, 8, 1][:n], [i for i in range(12) if i not in [5, 0, 11, 2, 8, 1][:n]]))
    assert left(k) <= 0.25 < left(k - 1)


@pytest.mark.parametrize("method", ["sdp_subopt_correct", "sdp_full"])
@pytest.mark.parametrize("m", [1, 3])
def test_whole_block_sdp(method, m):
    groups = np.repeat(np.arange(4), 3)
    sigma = simulate.blocks(groups, 0.6, 0.3)
    s = solvers.solve_s_group(sigma, groups, method, m)
    assert np.array_equal(s, solvers.block_diagonal(s, groups)) and np.linalg.eigvalsh(s)[0] > -1e-8
    assert np.linalg.eigvalsh((m + 1) / m * sigma - s)[0] > -1e-8 and (method == "sdp_subopt_correct" or s.min() > -1e-9)
    far = lambda s: np.abs(solvers.block_diagonal(sigma - s, groups)).sum()
    assert far(s) <= min(far(solvers.solve_s_group(sigma, groups, k, m)) for k in ("equi", "sdp_subopt")) + 0.02
    with pytest.raises(ValueError):
        solvers.solve_s_group(sigma + np.triu(np.ones((12, 12)), 1), groups, method)


def test_windowed_draws_per_window(spark):
    rng = np.random.default_rng(6)
    x = rng.multivariate_normal(np.full(9, 5.0), simulate.ar1(9, rho=0.5), 3000)
    rows = spark.createDataFrame([(i, r.tolist(), 1.0) for i, r in enumerate(x)], "row_id long, x array<double>, y double").repartition(5)
    made = controls.windowed(rows, m=2, ranges=[range(0, 2), range(2, 9)])
    got = made.rows.collect()
    assert len(got) == 3000 and made.rows.columns == ["row_id", "x", "xko", "y"]
    a, b = np.array([r.x for r in got]), np.array([r.xko for r in got])
    for r, mean, sigma, s in made.windows:
        for k in (0, 9):
            xk = b[:, k + r.start : k + r.stop]
            assert np.abs(np.cov(xk.T) - sigma).max() < 0.15 and np.abs(xk.mean(0) - 5).max() < 0.1
            cross = np.cov(a[:, r.start : r.stop].T, xk.T)[: len(r), len(r) :]
            assert np.abs(cross - (sigma - np.diag(s))).max() < 0.15
    with pytest.raises(ValueError):
        controls.windowed(rows, ranges=[range(0, 5)])


def test_fixed(spark):
    x = np.random.default_rng(4).standard_normal((60, 5))
    made = controls.fixed(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, x array<double>").repartition(3))
    rows = made.rows.collect()
    a, b = (np.array([r[c] for r in rows]) for c in ("x", "xko"))
    assert np.allclose(b.T @ b, made.sigma) and np.allclose(a.T @ b, made.sigma - np.diag(made.s))


def test_groups_and_representatives():
    groups = np.repeat(np.arange(4), 3)
    sigma = simulate.blocks(groups, 0.8, 0.1)
    for linkage in grouping.LINKAGES:
        assert (grouping.partition(sigma, 0.5, linkage=linkage) == groups).all()
    assert (grouping.partition(sigma, 0.5, contiguous=True) == groups).all()
    assert len(set(grouping.partition(sigma, 0.0, min_clusters=6))) == 6 and len(set(grouping.partition(sigma, 1.0))) == 12
    apart = np.eye(4)
    apart[0, 3] = apart[3, 0] = 0.9
    assert grouping.partition(apart, 0.5).tolist() == [0, 1, 2, 0] and len(set(grouping.partition(apart, 0.5, contiguous=True))) == 1
    reps = grouping.representatives(sigma, groups, 0.7)
    assert len(reps) >= 4 and set(groups[reps]) == set(range(4))
    for enforce in (False, True):
        used = grouping.conditionally_independent(sigma, groups, reps) if enforce else sigma
        s, d = grouping.solve_by_representatives(used, groups, reps, m=2)
        assert np.linalg.eigvalsh(1.5 * used - d)[0] > -1e-8 and np.allclose(d[np.ix_(reps, reps)], s)
        if enforce:
            assert np.abs(d[groups[:, None] != groups]).max() < 1e-8
    assert grouping.prioritised([11, 4, 5, 9, 7], [4, 9]) == [4, 9, 11, 5, 7]


def test_published_s():
    """Values for first-order correlations 0.4: the first five features and one in the middle."""
    sigma = simulate.ar1(120, rho=0.4)
    assert solvers.solve_s(sigma, "maxent")[[0, 1, 2, 3, 4, 60]] == pytest.approx([0.760607, 0.599795, 0.611403, 0.610539, 0.610604, 0.610599], abs=1e-4)
    assert solvers.solve_s(sigma, "mvr")[[0, 1, 2, 3, 4, 60]] == pytest.approx([0.705584, 0.5506, 0.557964, 0.5579, 0.557884, 0.557885], abs=1e-4)
    assert np.linalg.eigvalsh(simulate.erdos_renyi(30))[0] > 0
