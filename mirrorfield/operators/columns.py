"""Operators on the columns of rows (row_id, x array<double>): scaling, correlation, comparison with control copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorfield.operators import controls, grouping
from mirrorfield.operators.sums import array_sums


def column_sums(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squares about the means of x's columns; sums are of x less the mean of some rows."""
    some = rows.select(F.col("x").cast("array<double>").alias("x")).limit(64).collect()
    if not some:
        raise ValueError("no rows")
    shift = np.mean([r.x for r in some], axis=0)

    def part(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        y = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) - shift
        return {0: np.concatenate([[len(y)], y.sum(0), (y * y).sum(0)])}

    p = len(shift)
    n, s, square = np.split(array_sums(rows.select("x"), part, p)[0], [1, 1 + p])
    n = int(n[0])
    return n, shift + s / n, np.maximum(square - s * s / n, 0)


def _shifted(rows: DataFrame, take: np.ndarray, scale: np.ndarray) -> DataFrame:
    """x less take, over scale; columns of scale 0 become 0."""
    by = rows.sparkSession.createDataFrame([(take.tolist(), scale.tolist())], "_take array<double>, _scale array<double>")
    x = F.zip_with(F.zip_with("x", "_take", lambda v, t: v - t), "_scale", lambda v, s: F.when(s == 0, 0.0).otherwise(v / s))
    # one row of two numbers a column
    return rows.crossJoin(F.broadcast(by)).withColumn("x", x).drop("_take", "_scale")


def normalised(rows: DataFrame, center: bool = True) -> DataFrame:
    """Columns of x over their L2 norms, centred before the norm is taken if center."""
    n, mean, square = column_sums(rows)
    return _shifted(rows, mean, np.sqrt(square)) if center else _shifted(rows, 0 * mean, np.sqrt(square + n * mean**2))


def standardised(rows: DataFrame) -> DataFrame:
    """Columns of x as z-scores, n - 1 in the deviation."""
    n, mean, square = column_sums(rows)
    return _shifted(rows, mean, np.sqrt(square / max(n - 1, 1)))


def block(rows: DataFrame, first: int, many: int) -> DataFrame:
    """Columns first, first + 1, ... of x, many of them."""
    return rows.withColumn("x", F.slice("x", first + 1, many))


def _entries(rows: DataFrame, values: np.ndarray, keep: np.ndarray, name: str) -> DataFrame:
    i, j = np.nonzero(keep)
    table = pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), name: pa.array(values[i, j])})
    return rows.sparkSession.createDataFrame(table)


def _correlations(rows: DataFrame) -> np.ndarray:
    c = controls.moments(rows).centred
    sd = np.sqrt(np.diag(c))
    return c / np.where(sd == 0, np.nan, sd)[:, None] / np.where(sd == 0, np.nan, sd)


def correlation(rows: DataFrame) -> DataFrame:
    """(i, j, v) for j <= i: correlations of the columns, from one pass of sums of products."""
    r = _correlations(rows)
    return _entries(rows, r, np.tri(len(r), dtype=bool), "v")


def compare_correlation(made: DataFrame) -> DataFrame:
    """(i, j, r, r_ko) for j <= i of rows (x, xko), first copy: the correlation of features i and j, and of feature i with j's copy."""
    p = made.select(F.size("x")).first()[0]
    r = _correlations(made.select(F.concat("x", F.slice("xko", 1, p)).alias("x")))
    keep = np.tri(p, dtype=bool)
    return _entries(made, r[:p, :p], keep, "r").join(_entries(made, r[:p, p:], keep, "r_ko"), ["i", "j"])


def compare_pairwise_correlation(made: DataFrame) -> DataFrame:
    """(feature_id, r): the correlation of each feature with its first copy."""
    return compare_correlation(made).where("i = j").select(F.col("i").alias("feature_id"), F.col("r_ko").alias("r"))


def feature_groups(rows: DataFrame, **options) -> np.ndarray:
    """grouping.partition of the columns of x, by their sample covariance."""
    return grouping.partition(controls.moments(rows).covariance(), **options)
