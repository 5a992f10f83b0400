"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a seeded order, form blocks. Block k of a source of weight w is released at floor(k / w) and
due at ceil((k + 1) / w); at each slot the released block that is due first runs. Weights are whole numbers of
slots in a period, so the schedule repeats and one period describes it: at every slot each source has had within
one block of its weight's share. A source that runs out leaves its slots empty, and the others keep their ratio.

Of more than MAX_SOURCES sources those of the least weights form a pool that is scheduled as one source of their
summed weight; the pool's rows are in the order of their virtual times, (rank in the source + start) / weight.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorfield.llm.common import checkpointed, table

BLOCK = 16
#: Slots in a period; also the finest weight.
PERIOD = 4096
#: Sources that are scheduled each by itself, as the schedule has a row for each slot of a period, on the driver.
MAX_SOURCES = 1024
#: Rows that are numbered together, and counts of such rows.
BUCKET = 4096
#: Target weights of the query and of the pipeline; sources that are not named get the smallest.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 2.0, "src4": 1.0}


Source = TypeVar("Source", str, int)


def rounded(weights: Mapping[Source, float], period: int = PERIOD) -> dict[Source, int]:
    """Whole slots in a period, at least one for each source, by largest remainders; ties go to the smaller name."""
    if not weights:
        return {}
    if any(not (w > 0 and np.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (slots[s] - exact[s], s))
    while (left := period - sum(slots.values())) != 0:
        for s in order if left > 0 else reversed(order):
            if left and (left > 0 or slots[s] > 1):
                slots[s] += 1 if left > 0 else -1
                left += -1 if left > 0 else 1
    return slots


def schedule(slots: Mapping[Source, int]) -> list[tuple[Source, int, int]]:
    """(source, block in period, slot) of one period: of the released blocks the one that is due first runs, ties by source."""
    import heapq

    period = sum(slots.values())
    waiting = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-((k + 1) * period // -slots[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k, t))
        if k + 1 < slots[s]:
            heapq.heappush(waiting, ((k + 1) * period // slots[s], s, k + 1))
    return out


def _numbered(rows: DataFrame, key: str, bucket: str, *order: str) -> DataFrame:
    """rows with _rank, from 0 on within each key, by bucket and then by order. Buckets are sorted each by itself; their counts are summed in two steps."""
    sizes = rows.groupBy(key, bucket).count().withColumn("_super", F.floor(F.col(bucket) / BUCKET))
    supers = sizes.groupBy(key, "_super").agg(F.sum("count").alias("n"))
    supers = supers.withColumn("_above", F.sum("n").over(Window.partitionBy(key).orderBy("_super")) - F.col("n")).drop("n")
    within = F.sum("count").over(Window.partitionBy(key, "_super").orderBy(bucket)) - F.col("count")
    before = sizes.withColumn("_within", within).join(supers, [key, "_super"]).select(key, bucket, (F.col("_above") + F.col("_within")).alias("_before"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)) - 1)
    return inside.join(before, [key, bucket]).withColumn("_rank", F.col("_before") + F.col("_at")).drop("_before", "_at")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, seed: int = 42, by: str = "source", most: int = MAX_SOURCES) -> DataFrame:
    """docs with (mix_source, mix_block, mix_slot, mix_offset); ordered by (mix_slot, mix_offset) they are the mixture.

    Every row stays. weights: a positive number for each source; None: the square roots of the sources' row counts,
    and sources that weights lacks get the smallest weight. A null source is a source of its own, named "" (as the empty one). Rows are
    ordered within a source by a seeded hash of doc_id, ties by a hash of the whole row, so repeated rows are next to each other.
    mix_block counts the blocks of a source, or of the pool of sources beyond most, where mix_source is still the row's own.
    Columns of docs with the new names are replaced; no rows give no rows.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_source", "mix_block", "mix_slot", "mix_offset")])
    spark = docs.sparkSession
    source = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit(""))
    counts = docs.groupBy(source.alias("mix_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        counts = counts.withColumn("_w", F.sqrt("_n"))
    else:
        rounded(weights, max(period, len(weights)))  # for its checks
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "mix_source string, _w double")
        counts = counts.join(F.broadcast(given), "mix_source", "left").withColumn("_w", F.coalesce("_w", F.lit(float(min(weights.values(), default=1.0)))))
    counts = checkpointed(counts)
    first = counts.orderBy(F.desc("_w"), "mix_source").limit(most + 1).collect()
    pooled = len(first) > most
    first = first[: most - 1] if pooled else first
    units = {r["mix_source"]: i for i, r in enumerate(sorted(first, key=lambda r: r["mix_source"]))}
    target, sizes = {units[r["mix_source"]]: r["_w"] for r in first}, {units[r["mix_source"]]: r["_n"] for r in first}
    named = spark.createDataFrame(list(units.items()), "mix_source string, _unit long")
    if pooled:
        tail = counts.join(F.broadcast(named), "mix_source", "left_anti")
        total = tail.agg(F.sum("_w").alias("w"), F.sum("_n").alias("n"), F.max(F.col("_n") / F.col("_w")).alias("longest")).collect()[0]
        target[len(units)], sizes[len(units)] = total["w"], total["n"]
    slots = rounded(target, period)
    plan = spark.createDataFrame(schedule(slots), "_unit long, _k long, _slot long")
    shape = spark.createDataFrame([(u, n) for u, n in slots.items()], "_unit long, _per long")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    rows = docs.select(row, source.alias("mix_source"), F.xxhash64(F.lit(seed), "doc_id").alias("_order"), whole.alias("_tie"))
    # a third of all rows may be of one source: it has as many buckets as its count needs, whatever the partitions
    share = F.shiftrightunsigned("_order", 1) / F.lit(float(2**63))
    rows = rows.join(F.broadcast(counts) if pooled is False else counts, "mix_source").withColumn("_bucket", F.floor(share * F.ceil(F.col("_n") / BUCKET)))
    ranked = _numbered(rows, "mix_source", "_bucket", "_order", "_tie").join(F.broadcast(named), "mix_source", "left")
    ranked = ranked.withColumn("_unit", F.coalesce("_unit", F.lit(len(units))))
    if pooled:
        start = F.pmod(F.xxhash64("mix_source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        late = ranked.where(F.col("_unit") == len(units)).withColumn("_time", (F.col("_rank") + start) / F.col("_w")).drop("_rank", "_bucket")
        buckets = -(total["n"] // -BUCKET)
        late = late.withColumn("_bucket", F.floor(F.col("_time") / F.lit(float(total["longest"]) * (1 + 1e-9)) * buckets))
        late = _numbered(late, "_unit", "_bucket", "_time", "mix_source", "_order", "_tie").drop("_time")
        ranked = ranked.where(F.col("_unit") < len(units)).unionByName(late)
    ranked = ranked.join(F.broadcast(shape), "_unit")
    cut = ranked.withColumns({"mix_block": F.floor(F.col("_rank") / block), "mix_offset": F.pmod("_rank", F.lit(block)).cast("int")})
    placed = cut.withColumn("_k", F.pmod("mix_block", "_per")).join(F.broadcast(plan), ["_unit", "_k"])
    placed = placed.withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("_per")) * period + F.col("_slot"))
    return placed.select("_row.*", "mix_source", "mix_block", "mix_slot", "mix_offset")


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of all documents; the texts stay where they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return mix(docs, WEIGHTS).select("doc_id", "source", "mix_block", "mix_slot", "mix_offset")
