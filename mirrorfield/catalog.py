"""Queries over the driver's tables and the same in SQL.

The design matrix is that of embeddings. The response has a planted signal: features 0, 2, ... 30 with coefficients 1, 2 and
3 in turn, and some noise by row. For marginal scores the first half of a vector holds features, the second half
stands for their control copies (three copies: quarters). Sums of doubles are rounded to six places.

Queries that draw control copies return what must hold of them whatever the draw: identities of Gram matrices and means
where there are such, else whether s is feasible and whether moments of [x, xko] are those that theory gives, up to six
standard errors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorfield.functions import markov, simulate
from mirrorfield.operators import chains, columns, controls, filtering, grouping, solvers
from mirrorfield.plans import selection
from mirrorfield.sources import plink

Query = Callable[[SparkSession, str], DataFrame]
LEVELS = filtering.LEVELS


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    signal = F.aggregate(F.transform(x, lambda v, j: F.when((j % 2 == 0) & (j < 32), v * (1 + j % 3)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), x.alias("x"), (signal + F.col("vec_id") * 7919 % 1000 / 5000.0).alias("y"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _design(spark, sf_dir).select("row_id", F.posexplode("x").alias("feature_id", "v"), "y")


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _scores(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    scores = filtering.marginal_scores(_design(spark, sf_dir), copies)
    # rounded before anything is compared, so that ties and cuts don't hang on the order of sums
    return scores.select("feature_id", F.round("t0", 6).alias("t0"), F.transform("tk", lambda t: F.round(t, 6)).alias("tk"))


_Y = "list_sum([embedding[j + 1]::double * (1 + j % 3) for j in range(0, 31, 2)]) + (vec_id * 7919 % 1000) / 5000.0::double"
_LONG = f"long as (select vec_id as row_id, generate_subscripts(embedding, 1) - 1 as feature_id, unnest(embedding)::double as v, {_Y} as y from embeddings)"
_T = _LONG + ", t as (select feature_id as j, round(pow((count(*) - 1) * corr(v, y), 2) / count(*), 6) as t from long group by 1)"
_W1 = _T + ", w as (select a.j as feature_id, abs(a.t) - abs(b.t) as w from t a join t b on b.j = a.j + 32 where a.j < 32)"
_LEVELS = "levels as (select unnest([0.01, 0.05, 0.1, 0.25, 0.5]::double[]) as fdr)"
_TAU1 = _W1 + ", " + _LEVELS + """, c as (
  select distinct abs(w) as t, (select count(*) from w y where y.w >= abs(x.w)) as up, (select count(*) from w y where y.w <= -abs(x.w)) as down from w x where w <> 0
), tau as (select fdr, coalesce(min(t), 'infinity'::double) as threshold from levels left join c on up > 0 and (1 + down) / up::double <= fdr group by fdr)"""
_MK = _T + """, s as (
  select a.j as feature_id, a.t as t0, b.t as t1, c.t as t2, d.t as t3 from t a join t b on b.j = a.j + 16 join t c on c.j = a.j + 32 join t d on d.j = a.j + 48 where a.j < 16
), o as (select *, list_sort([t0, t1, t2, t3]) as e, list_sort([t1, t2, t3]) as k from s
), mk as (select feature_id, greatest(case when t1 > t0 then 1 else 0 end, case when t2 > t0 then 2 else 0 end, case when t3 > t0 then 3 else 0 end) as kappa, e[4] - e[2] as tau,
  t0 - k[2] as lead from o), m as (select feature_id, kappa, tau, case when kappa = 0 then lead else 0 end as w from mk)"""


def marginal_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("feature_id", "t0", F.get("tk", F.lit(0)).alias("t1"))


def difference_statistics(spark, sf_dir):
    return _rounded(filtering.difference_statistics(_scores(spark, sf_dir)), "w")


def fdr_threshold(spark, sf_dir):
    return _rounded(filtering.threshold(filtering.difference_statistics(_scores(spark, sf_dir)), LEVELS), "threshold")


def fdr_selection(spark, sf_dir):
    stats = filtering.difference_statistics(_scores(spark, sf_dir))
    return _rounded(filtering.select_features(stats, filtering.threshold(stats, LEVELS)), "w")


def multiple_statistics(spark, sf_dir):
    return _rounded(filtering.multiple_statistics(_scores(spark, sf_dir, 3)), "tau", "w")


def multiple_threshold(spark, sf_dir):
    return _rounded(filtering.multiple_threshold(filtering.multiple_statistics(_scores(spark, sf_dir, 3)), 3, LEVELS), "threshold")


def group_importance(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    groups = scores.select("feature_id", F.floor(F.col("feature_id") / 5).alias("group_id"))
    found = filtering.group_scores(scores, groups)
    return _rounded(found.select(F.col("feature_id").alias("group_id"), "t0", F.get("tk", F.lit(0)).alias("t1")), "t0", "t1")


def column_norms(spark, sf_dir):
    """Columns centred and over their norms: the largest and the smallest entry of each, and its norm."""
    long = columns.normalised(_design(spark, sf_dir)).select(F.posexplode("x").alias("feature_id", "v"))
    return _rounded(long.groupBy("feature_id").agg(F.sum(F.col("v") * F.col("v")).alias("norm"), F.max("v").alias("top"), F.min("v").alias("low")), "norm", "top", "low")


def standardised(spark, sf_dir):
    """Each entry as a z-score, n - 1 in the deviation."""
    return _rounded(columns.standardised(_design(spark, sf_dir)).select("row_id", F.posexplode("x").alias("feature_id", "z")), "z", places=5)


def correlation(spark, sf_dir):
    """Correlation of all pairs of features."""
    return _rounded(columns.correlation(_design(spark, sf_dir)), "v", places=5)


def _halves(spark, sf_dir):
    return _design(spark, sf_dir).select("row_id", F.slice("x", 1, 32).alias("x"), F.slice("x", 33, 32).alias("xko"))


def compare_correlation(spark, sf_dir):
    """The second half of each vector stands for the copies of the first."""
    return _rounded(columns.compare_correlation(_halves(spark, sf_dir)), "r", "r_ko", places=5)


def compare_pairwise_correlation(spark, sf_dir):
    return _rounded(columns.compare_pairwise_correlation(_halves(spark, sf_dir)), "r", places=5)


def window_partition(spark, sf_dir):
    p = _design(spark, sf_dir).select(F.size("x")).first()[0]
    return spark.createDataFrame([(j, k) for k, r in enumerate(controls.window_ranges(p, 10)) for j in r], "feature_id int, window_id int")


def column_block(spark, sf_dir):
    """Columns 8 to 11."""
    return columns.block(_design(spark, sf_dir), 8, 4).select("row_id", F.posexplode("x").alias("feature_id", "v"))


def auc(spark, sf_dir):
    pairs = _design(spark, sf_dir).select(F.round(F.get("x", F.lit(2)), 2).alias("score"), (F.col("y") >= 0).cast("int").alias("event"))
    return _rounded(filtering.auc(pairs).withColumn("reversed", filtering.auc(pairs, increasing=False).select("auc").scalar()), "auc", "reversed")


def r_squared(spark, sf_dir):
    pairs = _read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("yhat"))
    return _rounded(filtering.r_squared(pairs), "r2")


def nearest_match(spark, sf_dir):
    left = _read(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("z_pos"))
    right = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 131).alias("h_pos"))
    return filtering.nearest_match(left, right)


def power_and_fdp(spark, sf_dir):
    """Even features are the true ones."""
    truth = spark.range(0, 32, 2).select(F.col("id").cast("int").alias("feature_id"))
    return _rounded(filtering.power_and_fdp(fdr_selection(spark, sf_dir), truth, LEVELS), "power", "fdp")


def explained_variance(spark, sf_dir):
    """Factor count by 90 % of the variance, over prices per brand in the place of eigenvalues."""
    values = _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("v")).collect()
    return spark.createDataFrame([(controls.factors(np.sort([r.v for r in values])[::-1], "ve", len(values)),)], "k int")


def _genotype_rows(spark, sf_dir):
    """(sample_id, variant_id, g) of orders: 0, 1, 2, and sevens missing."""
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 50).alias("variant_id"), F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderkey") % 3).cast("tinyint").alias("g"))


def _genotypes(spark, sf_dir):
    """(variant_id, samples, g): the same, a row a variant."""
    o = _genotype_rows(spark, sf_dir)
    return o.groupBy("variant_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "g"))).alias("s")).select("variant_id", F.col("s.sample_id").alias("samples"), F.col("s.g").alias("g"))


def imputed_genotypes(spark, sf_dir):
    """Genotypes, mean-imputed per variant and standardised."""
    g = _genotype_rows(spark, sf_dir)
    # 50 variants
    found = plink.standardised_rows(g, F.broadcast(plink.spread(g)))
    return _rounded(found.select("sample_id", "variant_id", "x"), "x", places=5)


def genotypes_without_missing(spark, sf_dir):
    return plink.without_missing(_genotypes(spark, sf_dir)).select("variant_id", F.explode("g").alias("g")).groupBy("variant_id", "g").agg(F.count("*").alias("n"))


def block_covariance(spark, sf_dir):
    """Within-group correlation 0.4, between groups 0.2 of that, from the groups of nations by region."""
    n = _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    sigma = simulate.blocks([r.n_regionkey for r in n], 0.4, 0.2)
    return spark.createDataFrame([(a.n_nationkey, b.n_nationkey, float(sigma[i, j])) for i, a in enumerate(n) for j, b in enumerate(n)], "i int, j int, v double").withColumn("v", F.round("v", 6))


def ar1_covariance(spark, sf_dir):
    sigma = simulate.ar1(25, rho=0.6)
    return spark.createDataFrame([(i, j, round(float(sigma[i, j]), 6)) for i in range(25) for j in range(25)], "i int, j int, v double")


def group_sizes(spark, sf_dir):
    """Members of each single-linkage group of the features."""
    return linkage_groups(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members"))


def linkage_groups(spark, sf_dir):
    """Features joined, over any chain of them, by correlations of 0.15 or more."""
    found = columns.feature_groups(_design(spark, sf_dir), cutoff=0.15, linkage="single")
    return spark.createDataFrame([(j, int(g)) for j, g in enumerate(found)], "feature_id int, group_id int")


def _pairs_of_suppliers(spark, sf_dir):
    """A correlation for each of 20 suppliers, by rule, and the block-diagonal matrix of such pairs of features."""
    rows = _read(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(20).collect()
    rho = [(r.s_suppkey % 9) / 10 for r in rows]
    sigma = np.eye(2 * len(rho))
    for k, v in enumerate(rho):
        sigma[2 * k, 2 * k + 1] = sigma[2 * k + 1, 2 * k] = v
    return [r.s_suppkey for r in rows], sigma


def solved_pairs(spark, sf_dir):
    """s of pairs of features by method, where the optimum is known in closed form, and of the pairs as groups; the mean of a pair's s, to two places for sdp_ccd, whose optimum is flat."""
    ids, sigma = _pairs_of_suppliers(spark, sf_dir)
    found = {"maxent": solvers.solve_s(sigma, "maxent", niter=400, tol=1e-10), "sdp_ccd": solvers.solve_s(sigma, "sdp_ccd", mu=0.95, niter=400), "equi": solvers.solve_s(sigma, "equi")}
    groups = np.repeat(np.arange(len(ids)), 2)
    found["group_equi"] = np.diag(solvers.solve_s_group(sigma, groups, "equi"))
    found["group_maxent_block"] = np.diag(solvers.solve_s_group(sigma, groups, "maxent_block", tol=1e-9))
    return spark.createDataFrame([(k, i, round(float(s[2 * j] + s[2 * j + 1]) / 2, 2 if k == "sdp_ccd" else 4)) for k, s in found.items() for j, i in enumerate(ids)], "method string, s_suppkey long, s double")


def objectives(spark, sf_dir):
    """Block objectives of S = half of sigma's blocks, two copies."""
    ids, sigma = _pairs_of_suppliers(spark, sf_dir)
    groups = np.repeat(np.arange(len(ids)), 2)
    s = 0.5 * solvers.block_diagonal(sigma, groups)
    roots = np.linalg.cholesky(1.5 * sigma - s), np.linalg.cholesky(s)
    values = {k: solvers.group_block_objective(sigma, s, groups, 2, k) for k in ("sdp", "maxent", "mvr")}
    values |= {"maxent_of_roots": solvers.maxent_of_roots(*roots, 2), "mvr_of_roots": solvers.mvr_of_roots(*roots, 2)}
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in values.items()], "name string, v double")


_HAP = """h as (select n_nationkey as j, k, n_regionkey / 5.0::double + 0.1 as r, (1 + (n_nationkey + k) % 3) / 6.0::double as alpha, ((n_nationkey * 3 + k) % 7 + 1) / 10.0::double as theta from nation, range(3) t(k)
), t as (select x.j, x.k as a, y.k as b, (1 - exp(-y.r)) * y.alpha + case when x.k = y.k then exp(-y.r) else 0 end as p from h x join h y using (j)
), pr as (select x.j, x.k as a, y.k as b, x.alpha as aa, y.alpha as ab, x.theta as ta, y.theta as tb from h x join h y on x.j = y.j and x.k <= y.k)"""
_ETA = """with b as (select q as fdr, q * 2 as a0, list_transform(range(64), lambda j: ((j % 5) - 2) * q) as beta from (select unnest([0.01, 0.05, 0.1, 0.25, 0.5]::double[]) as q)),
  e as (select vec_id as row_id, fdr, a0 + list_dot_product(embedding::double[], beta::double[]) as eta from embeddings, b)"""


def _haplotypes(spark, sf_dir):
    """Three haplotypes at 25 variants, by rule: nations are the variants."""
    j = F.col("j")
    both = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("j"), F.col("n_regionkey").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return both.select("j", "k", (F.col("g") / 5.0 + 0.1).alias("r"), ((1 + (j + F.col("k")) % 3) / 6.0).alias("alpha"), (((j * 3 + F.col("k")) % 7 + 1) / 10.0).alias("theta"))


def pair_to_index(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b"), F.explode(F.sequence(F.lit(0).cast("int"), F.col("n_nationkey").cast("int"))).alias("a"))
    return n.select((F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"), markov.pair_index(F.col("a") + 1, F.col("b") + 1, 25).alias("i"))


def index_to_pair(spark, sf_dir):
    n = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")).where("i between 1 and 55")
    return n.select("i", markov.index_pair(F.col("i"), 10).alias("p")).select(F.col("i").cast("long").alias("i"), "p.a", "p.b")


def likelihood_ratio(spark, sf_dir):
    h = _haplotypes(spark, sf_dir).where("k < 2").groupBy("j").agg(F.min("theta").alias("a"), F.max("theta").alias("b"), F.min("alpha").alias("rho"))
    return _rounded(h.select("j", markov.likelihood_ratio(F.col("a"), F.col("b"), F.col("rho")).alias("v")), "v", places=4)


def haplotype_transition(spark, sf_dir):
    return _rounded(markov.haplotype_transitions(_haplotypes(spark, sf_dir)), "p")


def genotype_transition(spark, sf_dir):
    return _rounded(markov.genotype_transitions(_haplotypes(spark, sf_dir)), "p")


def initial_probabilities(spark, sf_dir):
    return _rounded(markov.initial(_haplotypes(spark, sf_dir)), "p")


def genotype_emission(spark, sf_dir):
    return _rounded(markov.genotype_emissions(_haplotypes(spark, sf_dir)), "p")


def linear_predict(spark, sf_dir):
    beta = spark.createDataFrame([(q, q * 2, [((j % 5) - 2) * q for j in range(64)]) for q in LEVELS], "fdr double, a0 double, beta array<double>")
    return _rounded(filtering.predict(_design(spark, sf_dir), beta), "yhat", places=5)


def logistic_predict(spark, sf_dir):
    beta = spark.createDataFrame([(q, q * 2, [((j % 5) - 2) * q for j in range(64)]) for q in LEVELS], "fdr double, a0 double, beta array<double>")
    return _rounded(filtering.predict(_design(spark, sf_dir), beta, logistic=True), "yhat", places=5)


def _groups(spark, sf_dir):
    return grouping.partition(controls.moments(_design(spark, sf_dir)).shrunk(), 0.05, min_clusters=16, linkage="average")


def _as_theory(found: controls.Moments, sigma: np.ndarray, s: np.ndarray, m: int) -> np.ndarray:
    """For each copy and feature, whether its covariances with all features and copies are, given those of the features, what the
    sampling law has, up to six standard errors."""
    p, n = len(sigma), found.n
    s = np.diag(s) if s.ndim == 1 else s
    pull = np.linalg.solve(sigma, s)
    cov, keep, noise = found.covariance(), np.eye(p) - pull, 2 * s - s @ pull
    x = cov[:p, :p]
    want = np.block([[x, *[x @ keep] * m], *[[keep.T @ x, *[keep.T @ x @ keep + noise - (0 if a == b else s) for b in range(m)]] for a in range(m)]])
    sd = np.sqrt(np.diag(want))
    fits = np.abs(cov - want) < 6 * np.outer(sd, sd) / np.sqrt(n) + 1e-9
    return fits[p:].all(1).reshape(m, p)


def _checked(rows: DataFrame, parts: list[tuple[range, np.ndarray, np.ndarray]], m: int) -> DataFrame:
    """(copy, feature_id, n, feasible, as_theory) of rows (x, xko); parts: ranges of features, their sigma and s."""
    out, n, p = [], 0, sum(len(r) for r, _, _ in parts)
    for r, sigma, s in parts:
        both = F.concat(F.slice("x", r.start + 1, len(r)), *[F.slice("xko", k * p + r.start + 1, len(r)) for k in range(m)])
        found = controls.moments(rows.select(both.alias("x")))
        n, full = found.n, np.diag(s) if s.ndim == 1 else s
        scale = np.abs(sigma).max()
        feasible = min(np.linalg.eigvalsh(full)[0], np.linalg.eigvalsh((m + 1) / m * sigma - full)[0]) > -1e-6 * scale
        fits = _as_theory(found, sigma, s, m)
        out += [(k, r.start + j, n, bool(feasible), bool(fits[k, j])) for k in range(m) for j in range(len(r))]
    return rows.sparkSession.createDataFrame(out, "copy int, feature_id int, n long, feasible boolean, as_theory boolean")


def _made(kind: str, *args, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _design(spark, sf_dir)
        labels = [_groups(spark, sf_dir)] if kind == "by_representatives" else []
        more = options | ({"groups": _groups(spark, sf_dir)} if options.get("groups") == "clusters" else {})
        made = getattr(controls, kind)(rows, *labels, *args, **more)
        if isinstance(made, controls.WindowedControls):
            return _checked(made.rows, [(r, sigma, s) for r, _, sigma, s in made.windows], made.m)
        return _checked(made.rows, [(range(len(made.mean)), made.sigma, made.s)], made.m)

    return query


def _factor(rule: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows, and whether all copies are numbers that differ from their features."""
        made = controls.factor(_design(spark, sf_dir), rule, m=2).select(F.size("x").alias("p"), "x", F.posexplode("xko").alias("k", "v"))
        each = made.select((F.col("k") % F.col("p")).alias("feature_id"), F.floor(F.col("k") / F.col("p")).cast("int").alias("copy"), (~F.isnan("v") & (F.col("v") != F.get("x", F.col("k") % F.col("p")))).alias("drawn"))
        return each.groupBy("copy", "feature_id").agg(F.count("*").alias("n"), F.every("drawn").alias("drawn"))

    return query


def fixed_controls(spark, sf_dir):
    """Gram matrices of fixed-design copies: among copies that of the columns; with other columns, too. Columns are over their norms."""
    made = controls.fixed(_design(spark, sf_dir).select("row_id", "x"))
    g = controls.moments(made.rows.select(F.concat("x", "xko").alias("x"))).gram
    p = len(g) // 2
    return spark.createDataFrame([(i, j, round(float(g[p + i, p + j]), 4), None if i == j else round(float(g[i, p + j]), 4)) for i in range(p) for j in range(p)], "i int, j int, copies double, cross_ double")


def hc_groups(spark, sf_dir):
    """Groups of features by each linkage."""
    sigma = controls.moments(_design(spark, sf_dir)).shrunk()
    found = {k: grouping.partition(sigma, 0.05, min_clusters=8, linkage=k) for k in grouping.LINKAGES} | {"contiguous": grouping.partition(sigma, 0.05, min_clusters=8, contiguous=True)}
    return spark.createDataFrame([(k, j, int(g)) for k, v in found.items() for j, g in enumerate(v)], "linkage string, feature_id int, group_id int")


def group_representatives(spark, sf_dir):
    sigma = controls.moments(_design(spark, sf_dir)).shrunk()
    return spark.createDataFrame([(int(j),) for j in grouping.representatives(sigma, _groups(spark, sf_dir))], "feature_id int")


def _states(made: DataFrame, most: int) -> DataFrame:
    """(feature_id, n, valid): rows, and whether all copies' states lie in 0 ... most."""
    return made.select(F.posexplode("xko").alias("feature_id", "v")).groupBy("feature_id").agg(F.count("*").alias("n"), F.every(F.col("v").between(0, most)).alias("valid"))


def hmm_controls(spark, sf_dir):
    """Genotypes are the features' signs and sizes in three classes; haplotypes by rule."""
    x = _design(spark, sf_dir).select("row_id", F.transform("x", lambda v: F.when(v < -0.05, 0).when(v < 0.05, 1).otherwise(2)).alias("x"))
    j, k = np.arange(64)[:, None], np.arange(3)
    return _states(chains.genotypes(x, chains.Haplotypes(np.full(64, 0.3), (1 + (j + k) % 3) / 6, ((j * 3 + k) % 7 + 1) / 10)), 2)


def markov_controls(spark, sf_dir):
    x = _design(spark, sf_dir).select("row_id", F.transform("x", lambda v: (v > 0).cast("int")).alias("x"))
    return _states(chains.markov(x, np.array([0.5, 0.5]), np.broadcast_to(np.array([[0.6, 0.4], [0.4, 0.6]]), (64, 2, 2))), 1)


def markov_cycle(spark, sf_dir):
    """A chain that only goes round: every copy is its chain."""
    x = _design(spark, sf_dir).select("row_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: ((F.col("row_id") + j) % 3).cast("int")).alias("x"))
    made = chains.markov(x, np.full(3, 1 / 3), np.broadcast_to(np.roll(np.eye(3), 1, axis=1), (10, 3, 3)))
    return made.select("row_id", F.posexplode("xko").alias("feature_id", "v"))


def genotype_files(spark, sf_dir):
    """From files to files in the folder that the cluster shares: with one haplotype of sure alleles, copies are what the alleles say."""
    import uuid

    home = (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/mirrorfield").rstrip("/") + f"/genotypes-{uuid.uuid4().hex}"
    rows = _read(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("row_id")).limit(200)
    g = rows.select("row_id", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda j: (2 * (j % 3 == 0).cast("int")).cast("int")).alias("x"))
    bim = spark.range(20).select(F.col("id").alias("variant_id"), F.lit("1").alias("chrom"), F.concat(F.lit("v"), "id").alias("snp_id"), F.lit(0.0).alias("cm"), (F.col("id") * 10).alias("pos"), F.lit("A").alias("a1"), F.lit("C").alias("a2"))
    fam = spark.range(g.count()).select(F.col("id").alias("sample_id"), F.lit("f").alias("family"), F.col("id").cast("string").alias("sample"), F.lit("0").alias("father"), F.lit("0").alias("mother"), F.lit(1).alias("sex"), F.lit("-9").alias("phenotype"))
    plink.made_folder(home)
    plink.write(plink.by_variant(g), bim, fam, f"{home}/in")
    chains.write_haplotypes(chains.Haplotypes(np.full(20, 0.5), np.ones((20, 1)), (np.arange(20) % 3 == 0).astype(float)[:, None]), f"{home}/model")
    chains.genotype_files(spark, f"{home}/in", f"{home}/model", f"{home}/out")
    back = plink.read(spark, f"{home}/out").join(plink.variants(spark, f"{home}/out").select("variant_id", "snp_id"), "variant_id")
    found = back.select("snp_id", F.size("g").cast("long").alias("n"), F.aggregate("g", F.lit(0).cast("long"), lambda a, v: a + v).alias("alleles")).toArrow()
    plink.removed_folder(home)
    return spark.createDataFrame(found)


def residual_controls(spark, sf_dir):
    """The design turned round, a row per feature, and its copies by windows of 16: shuffled residuals keep the mean and the intercept's fit."""
    long = _design(spark, sf_dir).select("row_id", F.posexplode("x").alias("variant_id", "v"))
    turned = long.groupBy("variant_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "v"))), lambda r: r["v"]).alias("g"))
    mean = F.aggregate("gko", F.lit(0.0), lambda a, v: a + v) / F.size("gko")
    return _rounded(controls.residual(turned, 16).select("variant_id", F.size("gko").cast("long").alias("n"), mean.alias("mean")), "mean")


def _hits(selected: DataFrame) -> DataFrame:
    """(fdr, hits): how many of the planted features are found at each rate."""
    truth = selected.sparkSession.range(0, 32, 2).select(F.col("id").cast("int").alias("feature_id"))
    return filtering.power_and_fdp(selected, truth, LEVELS).select("fdr", F.round(F.col("power") * 16).cast("int").alias("hits"))


def fit_lasso(spark, sf_dir):
    return _hits(selection.fit_lasso(_design(spark, sf_dir)).selected)


def fit_lasso_copies(spark, sf_dir):
    return _hits(selection.fit_lasso(_design(spark, sf_dir), m=3).selected)


def fit_lasso_groups(spark, sf_dir):
    """Neighbouring features in pairs are the groups; those with a planted feature are the true ones."""
    found = selection.fit_lasso(_design(spark, sf_dir), groups=(np.arange(64) // 2).tolist()).selected
    return _hits(found.withColumn("feature_id", F.col("feature_id") * 2))


def fit_lasso_logistic(spark, sf_dir):
    """The response is whether y is above its typical value; most: at least 12 of the 16 planted features are found."""
    rows = _design(spark, sf_dir).withColumn("y", (F.col("y") > 0.1).cast("double"))
    return _hits(selection.fit_lasso(rows, family="binomial").selected).select("fdr", (F.col("hits") >= 12).alias("most"))


def fit_marginal(spark, sf_dir):
    """Rates, and whether something is found at the largest; marginal scores of weak features may well lose to their copies."""
    found = selection.fit_marginal(_design(spark, sf_dir))
    return found.thresholds.join(found.selected.groupBy("fdr").count(), "fdr", "left").select("fdr", (F.coalesce("count", F.lit(0)) > 0).alias("finds")).where("fdr = 0.5")


def fitted_values(spark, sf_dir):
    """R2 of the refitted linear model of the features found at rate 0.25, to one place."""
    rows = _design(spark, sf_dir)
    found = selection.fit_lasso(rows, fdrs=[0.25], debias="ls")
    both = filtering.predict(rows, found.beta).join(rows.select("row_id", "y"), "row_id")
    return filtering.r_squared(both).select((F.col("r2") > 0.9).alias("fits"))


#: Queries that draw or solve, so that SQL can't express them.
GENERATORS: dict[str, Query] = {
    **{f"modelx_{k}": _made("gaussian", k) for k in ("equi", "sdp", "mvr", "maxent", "sdp_ccd")},
    "modelx_copies": _made("gaussian", "maxent", m=5),
    "windowed_controls": _made("windowed", 16),
    **{f"factor_{k}": _factor(k) for k in ("er", "gr", "ve")},
    **{f"group_{k}": _made("gaussian", k, groups="clusters") for k in ("equi", "sdp", "mvr", "maxent", "sdp_subopt", "sdp_subopt_correct", "sdp_full", "sdp_block", "mvr_block", "maxent_block")},
    "representative_controls": _made("by_representatives"),
    **{f.__name__: f for f in (fixed_controls, hc_groups, group_representatives, hmm_controls, markov_controls, markov_cycle, genotype_files, residual_controls)},
    **{f.__name__: f for f in (fit_lasso, fit_lasso_copies, fit_lasso_groups, fit_lasso_logistic, fit_marginal, fitted_values)},
}


def queries() -> dict[str, Query]:
    return GENERATORS | {
        f.__name__: f
        for f in (
            marginal_scores, difference_statistics, fdr_threshold, fdr_selection, multiple_statistics, multiple_threshold, group_importance, column_norms, standardised,
            correlation, compare_correlation, compare_pairwise_correlation, window_partition, column_block, auc, r_squared, nearest_match, power_and_fdp, explained_variance, imputed_genotypes, genotypes_without_missing, block_covariance, ar1_covariance, linkage_groups, group_sizes,
            solved_pairs, objectives, pair_to_index, index_to_pair, likelihood_ratio, haplotype_transition, genotype_transition, initial_probabilities, genotype_emission, linear_predict, logistic_predict,
        )
    }


_CHECKED = f"with {_LONG} select c.k as copy, feature_id, count(*) as n, true as feasible, true as as_theory from long, range({{m}}) c(k) group by 1, 2"
_STATES = f"with {_LONG} select feature_id, count(*) as n, true as valid from long group by 1"
#: With 16 planted features, all stronger than any copy, the ratio 1 / (m 16) is reached at once.
_HITS = "with " + _LEVELS + " select fdr, case when fdr >= 1 / ({m} * 16.0::double) then 16 else 0 end as hits from levels"
_COR = _LONG + ", r as (select a.feature_id as i, b.feature_id as j, corr(a.v, b.v) as v from long a join long b using (row_id) group by 1, 2)"
_LINKED = "with recursive " + _COR + """, reach(a, b) as (select i, i from r where i = j union select reach.a, r.j from reach join r on r.i = reach.b where abs(r.v) >= 0.15
), least as (select a, min(b) as l from reach group by 1), found as (select a as feature_id, dense_rank() over (order by l) - 1 as group_id from least)"""
_RHO = "rho as (select s_suppkey, (s_suppkey % 9) / 10.0::double as r from (select * from supplier order by s_suppkey limit 20))"


def _generators_sql() -> dict[str, str]:
    one, two = _CHECKED.format(m=1), f"with {_LONG} select c.k as copy, feature_id, count(*) as n, true as drawn from long, range(2) c(k) group by 1, 2"
    checked = [f"modelx_{k}" for k in ("equi", "sdp", "mvr", "maxent", "sdp_ccd")] + ["windowed_controls", "representative_controls"] + [k for k in GENERATORS if k.startswith("group_") and k != "group_representatives"]
    return {
        **dict.fromkeys(checked, one),
        "modelx_copies": _CHECKED.format(m=5),
        **{f"factor_{k}": two for k in ("er", "gr", "ve")},
        "hmm_controls": _STATES,
        "markov_controls": _STATES,
        "markov_cycle": "select vec_id as row_id, j as feature_id, (vec_id + j) % 3 as v from embeddings, range(10) t(j)",
        "genotype_files": "select 'v' || j || '.k' as snp_id, least(200, (select count(*) from customer)) as n, least(200, (select count(*) from customer)) * case when j % 3 = 0 then 2 else 0 end as alleles from range(20) t(j)",
        "residual_controls": f"with {_LONG} select feature_id as variant_id, count(*) as n, round(avg(v), 6) as mean from long group by 1",
        "fixed_controls": f"""with {_LONG}, g as (select a.feature_id as i, b.feature_id as j, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) as v from long a join long b using (row_id) group by 1, 2)
  select i, j, round(v, 4) as copies, case when i <> j then round(v, 4) end as cross_ from g""",
        "fit_lasso": _HITS.format(m=1),
        "fit_lasso_groups": _HITS.format(m=1),
        "fit_lasso_logistic": f"with {_LEVELS} select fdr, fdr >= 1 / 16.0::double as most from levels",
        "fit_lasso_copies": _HITS.format(m=3),
        "fit_marginal": "select 0.5::double as fdr, true as finds",
        "fitted_values": "select true as fits",
    }


def oracle_sql() -> dict[str, str]:
    return _generators_sql() | {
        "marginal_scores": f"with {_T} select a.j as feature_id, a.t as t0, b.t as t1 from t a join t b on b.j = a.j + 32 where a.j < 32",
        "difference_statistics": f"with {_W1} select feature_id, round(w, 6) as w from w",
        "fdr_threshold": f"with {_TAU1} select fdr, round(threshold, 6) as threshold from tau",
        "fdr_selection": f"with {_TAU1} select fdr, feature_id, round(w, 6) as w from w join tau on w >= threshold",
        "multiple_statistics": f"with {_MK} select feature_id, kappa, round(tau, 6) as tau, round(w, 6) as w from m",
        "multiple_threshold": f"""with {_MK}, {_LEVELS}, c as (
  select distinct tau as t, (select count(*) from m y where y.kappa = 0 and y.tau >= x.tau) as up, (select count(*) from m y where y.kappa >= 1 and y.tau >= x.tau) as down from m x where tau > 0
) select fdr, round(coalesce(min(t), 'infinity'::double), 6) as threshold from levels left join c on (1 + down) / (3.0::double * greatest(1, up)) <= fdr group by fdr""",
        "group_importance": f"with {_T} select a.j // 5 as group_id, round(sum(abs(a.t)), 6) as t0, round(sum(abs(b.t)), 6) as t1 from t a join t b on b.j = a.j + 32 where a.j < 32 group by 1",
        "column_norms": f"with {_LONG} select feature_id, 1.0::double as norm, round((max(v) - avg(v)) / sqrt(var_pop(v) * count(*)), 6) as top, round((min(v) - avg(v)) / sqrt(var_pop(v) * count(*)), 6) as low from long group by 1",
        "compare_correlation": f"with {_COR} select r.i, r.j, round(r.v, 5) as r, round(k.v, 5) as r_ko from r join r k on k.i = r.i and k.j = r.j + 32 where r.i < 32 and r.j <= r.i",
        "compare_pairwise_correlation": f"with {_COR} select i as feature_id, round(v, 5) as r from r where j = i + 32",
        "column_block": f"with {_LONG} select row_id, feature_id - 8 as feature_id, v from long where feature_id between 8 and 11",
        "genotypes_without_missing": "select o_custkey % 50 as variant_id, case when o_orderkey % 7 = 0 then 0 else o_orderkey % 3 end as g, count(*) as n from orders group by 1, 2",
        "ar1_covariance": "select i, j, round(pow(0.6, abs(i - j)), 6) as v from range(25) a(i), range(25) b(j)",
        "linkage_groups": f"{_LINKED} select feature_id, group_id from found",
        "group_sizes": f"{_LINKED} select group_id, count(*) as members from found group by 1",
        "solved_pairs": f"""with {_RHO}, least as (select min(1 - r) as l from rho), s as (select s_suppkey, r, (12 - sqrt(144 - 128 * (1 - r * r))) / 8 as maxent, least(1, 2 * (1 - r)) as sdp, least(1, 2 * l) as equi from rho, least)
  select 'maxent' as method, s_suppkey, round(maxent, 4) as s from s union all select 'sdp_ccd', s_suppkey, round(sdp, 2) from s union all select 'equi', s_suppkey, round(equi, 4) from s
  union all select 'group_equi', s_suppkey, 1.0 from s union all select 'group_maxent_block', s_suppkey, 1.0 from s""",
        "objectives": f"""with {_RHO}, o as (select sum(0.125 * (2 + 2 * r)) as sdp, sum(ln(1 - r * r) + 2 * (ln(0.25) + ln(1 - r * r))) as maxent, sum(4 * 4 / (1 - r * r) + 2 / (1 - r * r)) as mvr from rho)
  select 'sdp' as name, round(sdp, 4) as v from o union all select 'maxent', round(maxent, 4) from o union all select 'mvr', round(mvr, 4) from o union all select 'maxent_of_roots', round(maxent, 4) from o union all select 'mvr_of_roots', round(mvr, 4) from o""",
        "index_to_pair": "with p as (select a, b, row_number() over (order by a, b) as i from range(1, 11) x(a), range(1, 11) y(b) where a <= b) select i, a, b from p where i in (select s_suppkey from supplier)",
        "likelihood_ratio": f"with {_HAP}, l as (select j, min(theta) as a, max(theta) as b, min(alpha) as rho from h where k < 2 group by 1) select j, round(ln(0.9) + 0.1 / 0.9 * pow(1 - rho, 2) / (1 - a) / (1 - b) * 2 * rho * (1 - rho) / (a * (1 - b) + b * (1 - a)) * rho * rho / a / b, 4) as v from l",
        "standardised": f"with {_LONG} select row_id, feature_id, round((v - avg(v) over p) / stddev_samp(v) over p, 5) as z from long window p as (partition by feature_id)",
        "correlation": f"with {_LONG} select a.feature_id as i, b.feature_id as j, round(corr(a.v, b.v), 5) as v from long a join long b on a.row_id = b.row_id and b.feature_id <= a.feature_id group by 1, 2",
        "window_partition": f"with {_LONG} select distinct feature_id, feature_id // 10 as window_id from long",
        "auc": f"""with p as (select round(embedding[3]::double, 2) as score, ({_Y} >= 0)::int as event from embeddings),
  r as (select event, avg(rn) over (partition by score) as rank from (select *, row_number() over (order by score) as rn from p))
  , a as (select (sum(rank) filter (event = 1) - sum(event) * (sum(event) + 1) / 2.0) / (sum(event) * sum(1 - event)) as auc from r) select round(auc, 6) as auc, round(1 - auc, 6) as reversed from a""",
        "r_squared": "select round(1 - sum(pow(l_extendedprice - l_quantity * 1500.0, 2)) / (var_pop(l_extendedprice) * count(*)), 6) as r2 from lineitem",
        "nearest_match": """select z_pos, h_pos from (select p_partkey * 7 as z_pos, s_suppkey * 131 as h_pos, row_number() over (partition by p_partkey order by abs(p_partkey * 7 - s_suppkey * 131), s_suppkey) as n
  from part, supplier) where n = 1""",
        "power_and_fdp": f"""with {_TAU1}, s as (select l.fdr, w.feature_id from levels l join tau using (fdr) left join w on w >= threshold)
  select fdr, round(count(*) filter (feature_id % 2 = 0) / 16.0::double, 6) as power, round(count(*) filter (feature_id % 2 = 1) / greatest(1, count(feature_id))::double, 6) as fdp from s group by fdr""",
        "explained_variance": """with v as (select p_brand, round(sum(p_retailprice), 2) as v from part group by 1),
  r as (select row_number() over o as k, sum(v) over o / sum(v) over () as c from v window o as (order by v desc, p_brand rows unbounded preceding)) select min(k) as k from r where c > 0.9""",
        "imputed_genotypes": """with g as (select o_orderkey as sample_id, o_custkey % 50 as variant_id, case when o_orderkey % 7 = 0 then null else o_orderkey % 3 end as g from orders)
  , c as (select sample_id, variant_id, coalesce(g::double, avg(g) over p) - avg(g) over p as x from g window p as (partition by variant_id))
  select sample_id, variant_id, round(x / sqrt(sum(x * x) over p / (count(*) over p - 1)), 5) as x from c window p as (partition by variant_id)""",
        "block_covariance": "select a.n_nationkey as i, b.n_nationkey as j, case when a.n_nationkey = b.n_nationkey then 1.0::double when a.n_regionkey = b.n_regionkey then 0.4::double else 0.08::double end as v from nation a, nation b",
        "pair_to_index": "select a.n_nationkey + 1 as a, b.n_nationkey + 1 as b, row_number() over (order by a.n_nationkey, b.n_nationkey) as i from nation a join nation b on a.n_nationkey <= b.n_nationkey",
        "haplotype_transition": f"with {_HAP} select j, a, b, round(p, 6) as p from t",
        "genotype_transition": f"with {_HAP} select x.j, x.a, y.a as b, least(x.b, y.b) as c, greatest(x.b, y.b) as d, round(sum(x.p * y.p), 6) as p from t x join t y on x.j = y.j and x.a <= y.a group by all",
        "initial_probabilities": f"with {_HAP} select j, a, b, round(aa * ab * case when a = b then 1 else 2 end, 6) as p from pr",
        "genotype_emission": f"with {_HAP} select j, a, b, x, round(case x when 0 then (1 - ta) * (1 - tb) when 1 then ta * (1 - tb) + (1 - ta) * tb else ta * tb end, 6) as p from pr, range(3) g(x)",
        "linear_predict": f"{_ETA} select row_id, fdr, round(eta, 5) as yhat from e",
        "logistic_predict": f"{_ETA} select row_id, fdr, round(1 / (1 + exp(-eta)), 5) as yhat from e",
    }
