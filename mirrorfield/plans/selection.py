"""End to end: rows and response in, selected features at each target rate out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from mirrorfield.operators import controls, filtering, importance


@dataclass
class Selection:
    scores: DataFrame
    stats: DataFrame
    thresholds: DataFrame
    selected: DataFrame
    beta: DataFrame


def _spread(spark: SparkSession, t: np.ndarray, p: int, m: int) -> DataFrame:
    return spark.createDataFrame([(j, float(t[j]), [float(t[(k + 1) * p + j]) for k in range(m)]) for j in range(p)], "feature_id int, t0 double, tk array<double>")


def filtered(scores: DataFrame, m: int, fdrs: Sequence[float], plus: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    if m == 1:
        stats = filtering.difference_statistics(scores)
        cut = filtering.threshold(stats, fdrs, plus)
    else:
        if not plus:
            raise ValueError("several copies need the plus rule")
        stats = filtering.multiple_statistics(scores)
        cut = filtering.multiple_threshold(stats, m, fdrs)
    return stats, cut, filtering.select_features(stats, cut)


def fit_lasso(rows: DataFrame, fdrs: Sequence[float] = filtering.LEVELS, method: str = "maxent", m: int = 1, groups: Sequence[int] | None = None, mean=None, sigma=None, plus: bool = True, debias: str | None = None, stringent: bool = False, seed: int = 1, family: str = "gaussian", **lasso) -> Selection:
    """rows (row_id, x, y): controls, lasso importances, the filter, coefficients per target rate.

    family: gaussian, or binomial for y = 0 or 1. debias: a model without penalty (ls) or a lasso (lasso) on what was selected, or None
    for the first lasso's coefficients; a lasso refit is of gaussian y only. With groups all members of a selected group are refitted, if
    stringent only those with a coefficient. lasso: options of the cross-validation.
    """
    if debias not in ("ls", "lasso", None):
        raise ValueError("debias must be ls, lasso or None")
    if family not in importance.FAMILIES or (family == "binomial" and debias == "lasso"):
        raise ValueError("family must be gaussian, or binomial without a lasso refit")
    made = controls.gaussian(rows, method, mean, sigma, m, seed, groups)
    spark, p = rows.sparkSession, len(made.mean)
    if family == "binomial":
        grams, fit = [], importance.cross_validated_logistic(made.rows, seed=seed, **lasso)
    else:
        grams = importance.fold_grams(made.rows)
        fit = importance.cross_validated(grams, seed=seed, **lasso)
    scores = _spread(spark, fit.beta, p, m)
    if groups is not None:
        members = spark.createDataFrame([(j, int(g)) for j, g in enumerate(groups)], "feature_id int, group_id int")
        scores = filtering.group_scores(scores, members)
    stats, cut, selected = filtered(scores, m, fdrs, plus)
    chosen: dict[float, list[int]] = {q: [] for q in fdrs}
    for r in selected.collect():  # one row per feature and rate
        chosen[r.fdr].append(r.feature_id)
    labels, betas = np.arange(p) if groups is None else np.asarray(groups), []
    for q, ids in chosen.items():
        support = np.flatnonzero(np.isin(labels, ids))
        if stringent:
            support = support[fit.beta[support] != 0]
        beta, a0 = np.zeros(p), fit.intercept
        if debias and family == "binomial":
            again = importance.debiased_logistic(made.rows, support)
        elif debias:
            again = importance.debiased(sum(grams), support) if debias == "ls" else importance.debiased_lasso(grams, support)
        if debias:
            beta, a0 = again.beta[:p], again.intercept
        else:
            beta[support] = fit.beta[support]
        betas.append((float(q), float(a0), [float(b) for b in beta]))
    return Selection(scores, stats, cut, selected, spark.createDataFrame(betas, "fdr double, a0 double, beta array<double>"))


def fit_marginal(rows: DataFrame, fdrs: Sequence[float] = filtering.LEVELS, method: str = "maxent", m: int = 1, seed: int = 1, plus: bool = True, mean=None, sigma=None) -> Selection:
    """Like fit_lasso, with squared correlations as importances: Catalyst does all of it after sampling."""
    from pyspark.sql import functions as F

    made = controls.gaussian(rows, method, mean, sigma, m, seed)
    scores = filtering.marginal_scores(made.rows.select(F.concat("x", "xko").alias("x"), "y"), m)
    stats, cut, selected = filtered(scores, m, fdrs, plus)
    return Selection(scores, stats, cut, selected, rows.sparkSession.createDataFrame([], "fdr double, a0 double, beta array<double>"))
