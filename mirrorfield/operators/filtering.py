"""The filter itself as DataFrame operators: importance statistics, data-dependent thresholds, selections.

Tables: scores (feature_id, t0, tk array<double>) hold a feature's importance and that of its m control copies;
statistics (feature_id, w, kappa, tau) hold what the filter sorts by. There is a row per feature, never per sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorfield.operators.sums import bucketed, running_sums

LEVELS = (0.01, 0.05, 0.1, 0.25, 0.5)


def median(values: Column) -> Column:
    """The exact median of an array of doubles."""
    s, n = F.array_sort(values), F.size(values)
    half = F.floor((n - 1) / 2).cast("int")
    return (F.get(s, half) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def difference_statistics(scores: DataFrame) -> DataFrame:
    """(feature_id, w) with one copy: |t0| - |t1|."""
    return scores.select("feature_id", (F.abs("t0") - F.abs(F.get("tk", F.lit(0)))).alias("w"))


def multiple_statistics(scores: DataFrame, center=median) -> DataFrame:
    """(feature_id, kappa, tau, w): kappa is the last copy that beats the original, 0 if none does; tau is the largest score less the centre
    of the others; w the original's lead over the copies' centre where kappa is 0, else 0."""
    size = F.transform("tk", lambda t: F.abs(t))
    beating = F.transform(size, lambda t, i: F.when(t > F.abs("t0"), i + 1).otherwise(0))
    every = F.array_sort(F.concat(F.array(F.abs("t0")), size))
    kappa = F.array_max(beating)
    tau = F.array_max(every) - center(F.slice(every, 1, F.size(every) - 1))
    return scores.select("feature_id", kappa.alias("kappa"), tau.alias("tau"), F.when(kappa == 0, F.abs("t0") - center(size)).otherwise(0.0).alias("w"))


def _levels(df: DataFrame, fdrs: Sequence[float]) -> DataFrame:
    if any(not 0 <= q <= 1 for q in fdrs):
        raise ValueError("target rates must lie in [0, 1]")
    return df.withColumn("fdr", F.explode(F.array(*[F.lit(float(q)) for q in fdrs])))


def threshold(stats: DataFrame, fdrs: Sequence[float] = LEVELS, plus: bool = True, rej_bounds: int = 10_000) -> DataFrame:
    """(fdr, threshold): the smallest |w| > 0 at which (offset + how many w <= -|w|) / (how many w >= |w|) is at most fdr; infinity if none is.

    The largest rej_bounds + 1 candidates are looked at. Counts per distinct |w| are made before anything is ordered.
    """
    per = stats.select(F.abs("w").alias("t"), "w").groupBy("t").agg(F.count_if(F.col("w") > 0).alias("up"), F.count_if(F.col("w") < 0).alias("down"), F.count("*").alias("n")).where("t > 0")
    run = _from_above(per)
    ratio = (F.lit(int(plus)) + F.col("down")) / F.nullif(F.col("up"), F.lit(0))
    return _cut(run.where(F.col("before") <= rej_bounds).withColumn("ratio", ratio), stats, fdrs)


def _from_above(per: DataFrame) -> DataFrame:
    """(t, up, down, before): the counts of values of t or more, and of more."""
    run = running_sums(per, "t", ["up", "down", "n"], descending=True)
    return run.select("t", (F.col("before_up") + F.col("up")).alias("up"), (F.col("before_down") + F.col("down")).alias("down"), F.col("before_n").alias("before"))


def multiple_threshold(stats: DataFrame, m: int, fdrs: Sequence[float] = LEVELS, rej_bounds: int = 10_000) -> DataFrame:
    """(fdr, threshold) with m copies: the smallest tau > 0 at which (1 + how many kappa >= 1) / (m max(1, how many kappa = 0)), both of tau or more, is at most fdr."""
    per = stats.groupBy(F.col("tau").alias("t")).agg(F.count_if(F.col("kappa") == 0).alias("up"), F.count_if(F.col("kappa") >= 1).alias("down"), F.count("*").alias("n")).where("t > 0")
    run = _from_above(per)
    ratio = (1 + F.col("down")) / (m * F.greatest(F.lit(1), F.col("up")))
    return _cut(run.where(F.col("before") <= rej_bounds).withColumn("ratio", ratio), stats, fdrs)


def _cut(run: DataFrame, stats: DataFrame, fdrs: Sequence[float]) -> DataFrame:
    levels = _levels(stats.sparkSession.range(1).select(), fdrs)
    fits = levels.join(run, F.col("ratio") <= F.col("fdr"), "left").groupBy("fdr").agg(F.min("t").alias("t"))
    return fits.select("fdr", F.coalesce("t", F.lit(float("inf"))).alias("threshold"))


def select_features(stats: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(fdr, feature_id, w) of the features whose w reaches the threshold; thresholds has a row per target rate."""
    return stats.join(F.broadcast(thresholds), F.col("w") >= F.col("threshold")).select("fdr", "feature_id", "w")


def group_scores(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Scores summed in absolute value over the members of each group: (feature_id = group_id, t0, tk)."""
    long = scores.join(groups, "feature_id").select("group_id", F.abs("t0").alias("t0"), F.posexplode("tk").alias("k", "t"), F.size("tk").alias("m"))
    per = long.groupBy("group_id", "k").agg(F.sum("t0").alias("t0"), F.sum(F.abs("t")).alias("t"))
    return per.groupBy(F.col("group_id").alias("feature_id")).agg(F.first("t0").alias("t0"), F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("tk"))


def marginal_scores(rows: DataFrame, copies: int = 1) -> DataFrame:
    """Scores (feature_id, t0, tk) of (x array, y): squared inner products of the standardised columns over n.

    x holds the originals and then each copy's columns, in blocks of the same size.
    """
    long = rows.select(F.posexplode("x").alias("j", "v"), "y", (F.size("x") / (copies + 1)).cast("int").alias("p"))
    per = long.groupBy("j", "p").agg((F.pow((F.count("*") - 1) * F.corr("v", "y"), F.lit(2)) / F.count("*")).alias("t"))
    placed = per.select((F.col("j") % F.col("p")).alias("feature_id"), F.floor(F.col("j") / F.col("p")).alias("k"), F.coalesce("t", F.lit(0.0)).alias("t"))
    listed = placed.groupBy("feature_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda s: s["t"]).alias("s"))
    return listed.select("feature_id", F.get("s", F.lit(0)).alias("t0"), F.slice("s", 2, copies).alias("tk"))


def predict(rows: DataFrame, beta: DataFrame, logistic: bool = False) -> DataFrame:
    """(row_id, fdr, yhat) for each target rate: the inverse link of a0 + x . beta. beta: (fdr, a0, beta array), a row a rate, so it is broadcast."""
    eta = F.col("a0") + F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(F.broadcast(beta)).select("row_id", "fdr", (1 / (1 + F.exp(-eta)) if logistic else eta).alias("yhat"))


def r_squared(pairs: DataFrame) -> DataFrame:
    """(r2) of (y, yhat)."""
    return pairs.agg((1 - F.sum(F.pow(F.col("y") - F.col("yhat"), F.lit(2))) / (F.var_pop("y") * F.count("*"))).alias("r2"))


def auc(pairs: DataFrame, increasing: bool = True) -> DataFrame:
    """(auc) of (score, event 0/1), ties counted half. increasing: larger scores speak for events. Scores are counted before they are ordered."""
    per = pairs.groupBy("score").agg(F.sum("event").alias("up"), F.sum(1 - F.col("event")).alias("down"))
    run = running_sums(per, "score", ["down"])
    part = run.select((F.col("up") * (F.col("before_down") + F.col("down") / 2)).alias("area"), "up", "down")
    share = F.sum("area") / (F.sum("up") * F.sum("down"))
    return part.agg((share if increasing else 1 - share).alias("auc"))


def power_and_fdp(selected: DataFrame, truth: DataFrame, fdrs: Sequence[float] = LEVELS) -> DataFrame:
    """(fdr, power, fdp) of (fdr, feature_id) against the true (feature_id): the share of the true that is found, and of the found that is not true."""
    levels = _levels(selected.sparkSession.range(1).select(), fdrs)
    marked = selected.select("fdr", "feature_id").join(truth.select("feature_id").distinct().withColumn("hit", F.lit(1)), "feature_id", "left")
    per = levels.join(marked, "fdr", "left").groupBy("fdr").agg(F.count("hit").alias("hits"), F.count("feature_id").alias("n"))
    many = truth.select("feature_id").distinct().agg(F.count("*").alias("all"))
    return per.crossJoin(F.broadcast(many)).select("fdr", (F.col("hits") / F.greatest(F.lit(1), F.col("all"))).alias("power"), ((F.col("n") - F.col("hits")) / F.greatest(F.lit(1), F.col("n"))).alias("fdp"))


def nearest_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(z_pos, h_pos): for each position of left the nearest of right, the smaller on ties; null if right has none.

    Both are sorted within ranges of positions; of other ranges only the last position before and the first after count.
    """
    both = left.select(F.col("z_pos").cast("long").alias("pos"), F.lit(1).alias("z")).unionByName(right.select(F.col("h_pos").cast("long").alias("pos"), F.lit(0).alias("z")).distinct())
    dealt = bucketed(both.where("pos is not null"), "pos")
    ends = dealt.groupBy("_bucket").agg(F.min(F.when(F.col("z") == 0, F.col("pos"))).alias("first"), F.max(F.when(F.col("z") == 0, F.col("pos"))).alias("last"))
    # a row a range
    ordered = Window.orderBy("_bucket")
    borders = ends.select("_bucket", F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.min("first").over(Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    mine, range_ = F.when(F.col("z") == 0, F.col("pos")), Window.partitionBy("_bucket")
    low = F.last(mine, ignorenulls=True).over(range_.orderBy("pos", "z").rowsBetween(Window.unboundedPreceding, 0))
    high = F.last(mine, ignorenulls=True).over(range_.orderBy(F.desc("pos"), "z").rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumns({"low": low, "high": high}).where("z = 1").join(F.broadcast(borders), "_bucket")
    found = found.select("pos", F.coalesce("low", "below").alias("low"), F.coalesce("high", "above").alias("high"))
    return found.select(F.col("pos").alias("z_pos"), F.when(F.col("high").isNull() | (F.col("pos") - F.col("low") <= F.col("high") - F.col("pos")), F.col("low")).otherwise(F.col("high")).alias("h_pos"))
