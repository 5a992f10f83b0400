"""Exact top-k inner products with a pivot-distance index.

Vectors are keyed by nearest pivot and distance to it, sorted by this key and cut into blocks; a block knows its
pivot and its range of distances, an annulus, and its largest norm. For a query q and a vector x at distance r from
pivot p, the triangle inequality gives |q - x| >= |d(q, p) - r|, so
    q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + |x|^2 - (d(q, p) - r)^2) / 2.
Each query first searches the block that it stands in, which gives a score to beat. Blocks of queries meet blocks of
vectors by pivot, as bounds only; a pair whose bound is below the score to beat of all its queries goes no further.
Vectors move to the pairs that are left, where annuli are expanded from the best bound on, until the rest's is too low.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorfield.llm.common import checkpointed, table

K = 5
EVERY = 50
PIVOTS = 32
#: The pivots are chosen among this many vectors, those with the lowest hash of their id.
SAMPLE = 2048
BLOCK_ROWS, RING_ROWS = 1024, 128
#: Rows that a task packs.
TASK_ROWS = 16 * BLOCK_ROWS
#: Blocks of vectors that one task holds at most, blocks of queries that pass by them, and blocks whose bounds meet those of all queries in one task.
HELD, PASSING, BOUNDS = 64, 256, 4096
#: Bounds are raised by this share of their terms, far above what roots are rounded by.
SLACK = 1e-6
_BLOCK = "pivot int, near double, far double, norm double, taus binary, ids binary, sides binary, vectors binary"


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component. Rows with null vectors, null ids, or null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def choose_pivots(vectors: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Farthest-first pivots among a bounded sample of vectors of one length."""
    # a share that holds about four times the sample, so that tasks don't each send the whole of it
    share = 4.0 * sample / max(1, vectors.count())
    if share < 1:
        vectors = vectors.where(F.xxhash64("vec_id") < int((2 * share - 1) * (1 << 63)))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    x = np.array([r.v for r in rows], np.float64)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers: in doubles while all sums stay below 2 ** 53, else in integers."""
    most = float(np.abs(q.astype(np.float64)).sum(1).max()) * float(np.abs(x.astype(np.float64)).max())
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    out = q.astype(object) @ x.T.astype(object)
    if any(abs(p) >= 1 << 63 for p in out.ravel()):
        raise OverflowError("an inner product exceeds 64 bits")
    return out.astype(np.int64)


class _Index:
    def __init__(self, pivots: np.ndarray, dim: int, k: int, every: int):
        self.pivots, self.dim, self.k, self.every = pivots, dim, k, every

    def key(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), self.dim).astype(np.float64)
            apart = np.maximum((x**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T, 0)
            nearest = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest, pa.int32()), pa.array(np.sqrt(apart[np.arange(len(x)), nearest])), batch.column(1)], ["vec_id", "pivot", "r", "v"])

    def pack(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vec_id, pivot, r, v, tau) sorted by (pivot, r) -> blocks of up to BLOCK_ROWS rows of one pivot."""
        held: list[np.ndarray] | None = None

        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            ids, pivot, r, x, tau = part
            values = [[int(pivot[0])], [float(r[0])], [float(r[-1])], [float((x.astype(np.float64) ** 2).sum(1).max())], *[[c.tobytes()] for c in (tau, ids, r, x.astype(np.int64))]]
            types = [pa.int32(), *[pa.float64()] * 3, *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["pivot", "near", "far", "norm", "taus", "ids", "sides", "vectors"])

        for batch in batches:
            plain = [batch.column(i).to_numpy() for i in (0, 1, 2)]
            now = [*plain, _matrix(batch.column(3), self.dim), batch.column(4).to_numpy()]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            while len(held[0]) and (len(held[0]) > BLOCK_ROWS or held[1][0] != held[1][-1]):
                cut = min(BLOCK_ROWS, int(np.searchsorted(held[1], held[1][0], side="right")))
                yield out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield out(held)

    def block(self, row: dict) -> tuple[np.ndarray, ...]:
        """ids, distances, vectors, scores to beat."""
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sides"]), np.frombuffer(row["vectors"], np.int64).reshape(-1, self.dim), np.frombuffer(row["taus"])

    def asked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks -> the queries that stand in them (vec_id, pivot, r, v, tau): tau is the score of the k-th best row of their block."""
        for batch in batches:
            for row in batch.to_pylist():
                ids, r, x, _ = self.block(row)
                mine = np.flatnonzero(ids % self.every == 0)
                if not len(mine):
                    continue
                scores = products(x[mine], x).astype(np.float64)
                scores[ids[mine][:, None] == ids] = -np.inf
                tau = np.sort(scores, 1)[:, -self.k] if len(ids) >= self.k else np.full(len(mine), -np.inf)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * self.dim), pa.array(x[mine].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(np.full(len(mine), row["pivot"]), pa.int32()), pa.array(r[mine]), lists, pa.array(tau)], ["vec_id", "pivot", "r", "v", "tau"])

    def bounds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries -> (q_id, pivot, q_near, q_far, q_norm, least) for each pivot; least is the lowest score to beat."""
        for batch in batches:
            for row in batch.to_pylist():
                _, _, q, tau = self.block(row)
                apart = np.sqrt(((q[:, None, :].astype(np.float64) - self.pivots) ** 2).sum(2))
                n = len(self.pivots)
                columns = [np.full(n, row["b_id"]), np.arange(n, dtype=np.int32), apart.min(0), apart.max(0), np.full(n, row["norm"]), np.full(n, tau.min())]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["q_id", "pivot", "q_near", "q_far", "q_norm", "least"])

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard: first its blocks of vectors, which are held, then blocks of queries, each with the numbers of those that it meets."""
        shard, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if shard != (row["shard"], row["passing"]):
                    shard, held = (row["shard"], row["passing"]), {}
                if row["meets"] is None:
                    held[row["b_id"]] = row["pivot"], *self.block(row)[:3]
                    continue
                found = self.best(self.block(row), [held[b] for b in row["meets"]])
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    def best(self, asked: tuple[np.ndarray, ...], blocks: list[tuple]) -> list[tuple[int, int, int]]:
        """(query, row, score) of up to k best rows of each query that reach its tau. Rings of rows go from the best bound on."""
        ids, _, q, tau = asked
        square, tau, scores = (q.astype(np.float64) ** 2).sum(1), tau.copy(), [[] for _ in ids]
        for pivot, have, r, x in blocks:
            norms = (x.astype(np.float64) ** 2).sum(1)
            own = np.sqrt(((q - self.pivots[pivot]) ** 2).sum(1))
            rings = [(i, min(i + RING_ROWS, len(r))) for i in range(0, len(r), RING_ROWS)]
            gap = np.stack([np.maximum(0, np.maximum(r[a] - own, own - r[b - 1])) for a, b in rings])
            norm = np.array([norms[a:b].max() for a, b in rings])[:, None]
            bound = (square + norm - gap**2) / 2 + SLACK * (1 + square + norm + gap**2)
            order = np.argsort(-bound, axis=0, kind="stable")
            for step in range(len(rings)):
                open_ = np.flatnonzero(bound[order[step], np.arange(len(ids))] >= tau)
                if not len(open_):
                    break
                for ring in np.unique(order[step][open_]):
                    mine = open_[order[step][open_] == ring]
                    a, b = rings[ring]
                    scored = products(q[mine], x[a:b])
                    other = ids[mine][:, None] != have[a:b]
                    for i, p, ok in zip(mine, scored, other):
                        good = np.flatnonzero(ok & (p >= tau[i] - 1e-9 * abs(tau[i]) if np.isfinite(tau[i]) else ok))
                        if len(good):
                            scores[i] = sorted([*scores[i], *zip((-p[good]).tolist(), have[a:b][good].tolist())])[: self.k]
                            if len(scores[i]) == self.k:
                                tau[i] = max(tau[i], -scores[i][-1][0])
        return [(int(i), v, -s) for i, best in zip(ids, scores) for s, v in best]


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, v) whose id every divides, the k best inner products with other rows.

    Ties go to the smaller vec_id. A query's own row is what has its vec_id, so repeated rows of a query's id are not its results; repeated rows
    of other ids are merged if equal, else each is a candidate. Vectors meet those of their own length only; without components
    they take no part. Inner products must fit 64 bits, else it is an error. Empty input gives no rows.
    """
    vectors = checkpointed(vectors.select("vec_id", "v").distinct())
    dims = sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect() if r[0] > 0)
    if not dims:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    found = [_of_length(vectors.where(F.size("v") == d), d, every, k, pivots, sample) for d in dims]
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_length(vectors: DataFrame, dim: int, every: int, k: int, pivots: int, sample: int) -> DataFrame:
    index = _Index(choose_pivots(vectors, pivots, sample), dim, k, every)
    sort = ["pivot", "r", "vec_id"]

    def packed(rows: DataFrame) -> DataFrame:
        """Blocks follow the rows, not the partitions that a session happens to have: fewer, fuller ones where rows are few."""
        parts = max(1, -(rows.count() // -TASK_ROWS))
        out = rows.repartitionByRange(parts, *sort).coalesce(parts).sortWithinPartitions(*sort).mapInArrow(index.pack, _BLOCK)
        return checkpointed(out.withColumn("b_id", F.monotonically_increasing_id()))

    keyed = checkpointed(vectors.mapInArrow(index.key, "vec_id long, pivot int, r double, v array<long>")).withColumn("tau", F.lit(float("-inf")))
    blocks = packed(keyed)
    asked = packed(checkpointed(blocks.mapInArrow(index.asked, "vec_id long, pivot int, r double, v array<long>, tau double")))
    n, n_asked = blocks.count(), asked.count()
    # bounds meet by pivot; a pivot of very many blocks is dealt out
    salts = -(n // -BOUNDS)
    bounds = asked.mapInArrow(index.bounds, "q_id long, pivot int, q_near double, q_far double, q_norm double, least double").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    slim = blocks.select("b_id", "pivot", "near", "far", "norm", F.pmod(F.xxhash64("b_id"), F.lit(salts)).cast("int").alias("salt"))
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("q_far"), F.col("q_near") - F.col("far"))
    terms = F.col("q_norm") + F.col("norm")
    reaches = (terms - gap * gap) / 2 + SLACK * (1 + terms + gap * gap) >= F.col("least")
    pairs = bounds.join(slim, ["pivot", "salt"]).where(reaches).select("q_id", "b_id")
    # vectors of a shard, HELD blocks at most, are held by one task for each PASSING blocks of queries
    shards = -(n // -min(HELD, max(1, n // HELD)))
    pairs = checkpointed(pairs.withColumns({"shard": F.pmod(F.xxhash64("b_id"), F.lit(shards)), "passing": F.pmod(F.xxhash64("q_id"), F.lit(max(1, -(n_asked // -PASSING))))}))
    data = ["b_id", "pivot", "taus", "ids", "sides", "vectors"]
    held = blocks.select(*data).join(pairs.select("shard", "passing", "b_id").distinct(), "b_id").withColumn("meets", F.lit(None).cast("array<bigint>"))
    met = pairs.groupBy("shard", "passing", F.col("q_id").alias("b_id")).agg(F.collect_list("b_id").alias("meets"))
    passing = asked.select(*data).join(met, "b_id")
    rows = held.unionByName(passing).repartition("shard", "passing").sortWithinPartitions("shard", "passing", F.col("meets").isNotNull())
    return rows.mapInArrow(index.search, "query_id long, vec_id long, score long")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")))


OP6_SQL = """
with v as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 5
"""
