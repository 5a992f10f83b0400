"""The filter against plain loops over random importances."""

import math
import random

import numpy as np
import pytest

from mirrorfield.operators import filtering, sums

FDRS = [0.05, 0.1, 0.2, 0.4, 0.8]


def frame(spark, values, schema):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "feature_id int, " + schema)


def plain_threshold(ws, q, plus):
    fits = [t for t in {abs(w) for w in ws if w} if (sum(w >= t for w in ws) and (plus + sum(w <= -t for w in ws)) / sum(w >= t for w in ws) <= q)]
    return min(fits, default=math.inf)


@pytest.mark.parametrize("plus", [True, False])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_threshold(spark, seed, plus):
    rng = random.Random(seed)
    ws = [round(rng.gauss(0.8 if i % 3 else 0, 1), 1) for i in range(60)]
    got = {r.fdr: r.threshold for r in filtering.threshold(frame(spark, [(w,) for w in ws], "w double"), FDRS, plus).collect()}
    assert got == {q: plain_threshold(ws, q, plus) for q in FDRS} and min(got.values()) < math.inf
    stats = frame(spark, [(w,) for w in ws], "w double")
    chosen = filtering.select_features(stats, filtering.threshold(stats, FDRS, plus))
    assert {(r.fdr, r.feature_id) for r in chosen.collect()} == {(q, i) for q in FDRS for i, w in enumerate(ws) if w >= got[q]}


def test_no_positive_importance(spark):
    stats = frame(spark, [(-0.5,), (0.0,), (-1.0,)], "w double")
    assert {r.threshold for r in filtering.threshold(stats, FDRS).collect()} == {math.inf}


@pytest.mark.parametrize("m", [2, 3, 4])
def test_multiple(spark, m):
    rng = random.Random(m)
    scores = [[rng.choice([-1, 1]) * round(rng.random() + (0.5 if k == 0 and i % 2 else 0), 1) for k in range(m + 1)] for i in range(50)]
    stats = filtering.multiple_statistics(frame(spark, [(float(s[0]), [float(v) for v in s[1:]]) for s in scores], "t0 double, tk array<double>"))
    got = {r.feature_id: r for r in stats.collect()}
    kappa, tau = [], []
    for i, s in enumerate(scores):
        size = [abs(v) for v in s]
        kappa.append(max([k for k in range(1, m + 1) if size[k] > size[0]], default=0))
        tau.append(max(size) - float(np.median(sorted(size)[:-1])))
        assert got[i].kappa == kappa[i] and got[i].tau == pytest.approx(tau[i])
        assert got[i].w == pytest.approx(size[0] - np.median(size[1:]) if not kappa[i] else 0)
    tau = [got[i].tau for i in range(50)]
    cut = {r.fdr: r.threshold for r in filtering.multiple_threshold(stats, m, FDRS).collect()}
    for q in FDRS:
        fits = [t for t in tau if t > 0 and (1 + sum(k > 0 and v >= t for k, v in zip(kappa, tau))) / (m * max(1, sum(k == 0 and v >= t for k, v in zip(kappa, tau)))) <= q]
        assert cut[q] == min(fits, default=math.inf)


def test_power_and_fdp(spark):
    selected = spark.createDataFrame([(0.1, 1), (0.1, 2), (0.1, 9), (0.2, 9)], "fdr double, feature_id int")
    truth = spark.createDataFrame([(1,), (2,), (3,), (3,)], "feature_id int")
    got = {r.fdr: (r.power, r.fdp) for r in filtering.power_and_fdp(selected, truth, [0.05, 0.1, 0.2]).collect()}
    assert got == {0.05: (0, 0), 0.1: (pytest.approx(2 / 3), pytest.approx(1 / 3)), 0.2: (0, 1)}


@pytest.fixture(params=[1 << 16, 7])
def ranges(request, monkeypatch):
    """Few rows in one range, or in many."""
    monkeypatch.setattr(sums, "bucketed", lambda rows, by, plain=sums.bucketed: plain(rows, by, request.param))
    monkeypatch.setattr(filtering, "bucketed", sums.bucketed)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, ranges, descending):
    values = {k: (k * 37) % 11 for k in random.Random(4).sample(range(1000), 90)}
    got = sums.running_sums(spark.createDataFrame(list(values.items()), "k int, v long"), "k", ["v"], descending).collect()
    assert len(got) == 90 and all(r.before_v == sum(v for k, v in values.items() if (k > r.k if descending else k < r.k)) for r in got)


def test_auc(spark, ranges):
    rng = random.Random(5)
    pairs = [(round(rng.random() + 0.3 * (i % 2), 1), i % 2) for i in range(80)]
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, e in pairs if e for b, f in pairs if not f]
    frame_ = spark.createDataFrame(pairs, "score double, event int")
    assert filtering.auc(frame_).first().auc == pytest.approx(np.mean(wins))
    assert filtering.auc(frame_, increasing=False).first().auc == pytest.approx(1 - np.mean(wins))


def test_nearest_match(spark, ranges):
    rng = random.Random(6)
    z, h = [rng.randrange(-500, 500) for _ in range(120)], [rng.randrange(-300, 700) for _ in range(60)]
    got = filtering.nearest_match(spark.createDataFrame([(v,) for v in z], "z_pos long"), spark.createDataFrame([(v,) for v in [*h, h[0]]], "h_pos long")).collect()
    assert sorted((r.z_pos, r.h_pos) for r in got) == sorted((v, min(h, key=lambda p: (abs(p - v), p))) for v in z)
    none = filtering.nearest_match(spark.createDataFrame([(1,)], "z_pos long"), spark.createDataFrame([], "h_pos long"))
    assert [tuple(r) for r in none.collect()] == [(1, None)]
