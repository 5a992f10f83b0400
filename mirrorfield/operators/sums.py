"""Sums of arrays over all rows, on the cluster, and running sums without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Partial sums of a key that reach the driver at most.
LAST = 8
#: Bytes of rows that the driver adds up itself at most, and those that it does whatever the size of their sums.
HELD = 1 << 27
FEW = 1 << 23


def array_sums(rows: DataFrame, part: Callable[[pa.RecordBatch], dict[int, np.ndarray]], width: int, size: int = 0) -> dict[int, np.ndarray]:
    """By key the sums of the arrays that part makes of a batch; width: about how many numbers a row has; size: how many the sums of all keys have.

    Rows are added up on the driver if they take FEW bytes at most, or no more than LAST times their sums and HELD: what is sent there doesn't grow with
    the rows, and is no more than the partial sums would be where those are large. Else each task adds its batches up; then a tree of shuffles, each to the square root of the tasks before, adds up the tasks,
    so the driver gets LAST arrays a key at most, whatever the number of tasks. There is one shuffle at least, as the driver fetches a task at a time: rows are read before that, by all tasks at once.
    """

    def out(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([g.tobytes() for g in total.values()], pa.binary())], ["key", "data"])

    def add(total: dict[int, np.ndarray], more: dict[int, np.ndarray]) -> None:
        for k, v in more.items():
            total[k] = total[k] + v if k in total else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(total, part(batch))
        yield out(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                add(total, {batch.column(0)[i].as_py(): np.frombuffer(batch.column(1)[i].as_buffer())})
        yield out(total)

    if rows.count() * width * 8 <= min(HELD, max(FEW, LAST * size * 8)):
        total: dict[int, np.ndarray] = {}
        for batch in rows.toArrow().combine_chunks().to_batches():
            if batch.num_rows:
                add(total, part(batch))
        return total
    schema = "key int, data binary"
    sums = rows.mapInArrow(run, schema)
    tasks = sums.rdd.getNumPartitions()
    alone = tasks > 1
    while alone or tasks > LAST:
        alone = False
        tasks = int(np.ceil(np.sqrt(tasks)))
        sums = sums.repartition(tasks, "key", F.pmod(F.spark_partition_id(), F.lit(tasks))).mapInArrow(merge, schema)
    total = {}
    for row in sums.toLocalIterator():
        add(total, {row.key: np.frombuffer(row.data)})
    return total


def bucketed(rows: DataFrame, by: str, per_bucket: int = 1 << 16, most: int = 256) -> DataFrame:
    """rows with _bucket, ascending with column by: ranges of about equal numbers of rows; nulls are in the first."""
    n = min(most, max(1, rows.count() // per_bucket))
    splits = sorted(set(rows.approxQuantile(by, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    low = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < F.col(by))) if splits else F.lit(0)
    return rows.withColumn("_bucket", F.coalesce(low, F.lit(0)))


def running_sums(rows: DataFrame, by: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """rows with before_<column>: each column's sum over the rows that come before in the order of by, which tells rows apart.

    Rows are sorted within ranges of by; only the ranges' totals, a bounded number, meet in one task.
    """
    dealt = bucketed(rows, by)
    key = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    order = F.col(by).desc() if descending else F.col(by).asc()
    totals = dealt.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in columns])
    above = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_bucket", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above_{c}") for c in columns])
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    # a row a range
    found = found.join(F.broadcast(before), "_bucket")
    return found.select(*rows.columns, *[(F.col(f"_above_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in columns])
