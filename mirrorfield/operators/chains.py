"""Control copies of discrete Markov chains and of genotypes from a hidden Markov model, drawn where the rows lie.

Draws are seeded by (seed, row_id). Rows are worked on together, as many as keep the forward table within CELLS numbers;
transition matrices are made per variant when they are needed, never all at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mirrorfield.sources import plink

CELLS = 1 << 24
FLOOR = 1e-10


def _draw(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One state a row, in proportion to its weights."""
    run = np.cumsum(weights, axis=1)
    return np.minimum((run <= u[:, None] * run[:, -1:]).sum(1), weights.shape[1] - 1)


def chain_controls(z: np.ndarray, start: np.ndarray, step: Callable[[int], np.ndarray], u: np.ndarray) -> np.ndarray:
    """A control chain for each row of states z; step(j) leads from j - 1 to j, u holds a uniform number for each state."""
    n, p = z.shape
    out = np.empty_like(z)
    weight = np.broadcast_to(start, (n, len(start)))
    norm = np.ones((n, len(start)))
    for j in range(p):
        if j:
            q = step(j)
            weight = q[z[:, j - 1]] * q[out[:, j - 1]] / norm
        if j == p - 1:
            out[:, j] = _draw(weight, u[:, j])
            break
        ahead = step(j + 1)
        norm = np.maximum(weight @ ahead, FLOOR)
        out[:, j] = _draw(weight * ahead[:, z[:, j + 1]].T, u[:, j])
    return out


def sample_chain(n: int, p: int, start: np.ndarray, step: Callable[[int], np.ndarray], seed: int = 1) -> np.ndarray:
    u = np.random.default_rng(seed).random((n, p))
    z = np.empty((n, p), np.int64)
    for j in range(p):
        z[:, j] = _draw(step(j)[z[:, j - 1]] if j else np.broadcast_to(start, (n, len(start))), u[:, j])
    return z


@dataclass
class Haplotypes:
    """r: p; alpha, theta: p x K."""

    r: np.ndarray
    alpha: np.ndarray
    theta: np.ndarray

    def __post_init__(self) -> None:
        k = self.alpha.shape[1]
        self.a, self.b = np.triu_indices(k)

    def start(self) -> np.ndarray:
        q = self.alpha[0][self.a] * self.alpha[0][self.b] * np.where(self.a == self.b, 1, 2)
        if not np.isclose(q.sum(), 1, atol=1e-4):
            raise ValueError("alpha must sum to 1")
        return q

    def step(self, j: int) -> np.ndarray:
        stay = np.exp(-self.r[j])
        t = (1 - stay) * self.alpha[j] + stay * np.eye(self.alpha.shape[1])
        a, b = self.a, self.b
        straight = t[np.ix_(a, a)] * t[np.ix_(b, b)]
        return straight + np.where(a == b, 0, t[np.ix_(a, b)] * t[np.ix_(b, a)])

    def emission(self, j: int) -> np.ndarray:
        """3 x states: chance of genotype 0, 1, 2."""
        x, y = self.theta[j][self.a], self.theta[j][self.b]
        return np.stack([(1 - x) * (1 - y), x * (1 - y) + (1 - x) * y, x * y])

    def states(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Hidden states drawn given genotypes; negative genotypes are missing and say nothing."""
        n, p = x.shape
        forward = np.empty((p, n, len(self.a)))
        for j in range(p):
            seen = np.vstack([self.emission(j), np.ones(len(self.a))])[x[:, j]]
            now = (forward[j - 1] @ self.step(j) if j else self.start()) * seen
            forward[j] = now / np.maximum(now.sum(1, keepdims=True), 1e-300)
        z = np.empty((n, p), np.int64)
        z[:, -1] = _draw(forward[-1], u[:, -1])
        for j in range(p - 2, -1, -1):
            z[:, j] = _draw(forward[j] * self.step(j + 1)[:, z[:, j + 1]].T, u[:, j])
        return z

    def genotypes(self, z: np.ndarray, u: np.ndarray) -> np.ndarray:
        out = np.empty_like(z)
        for j in range(z.shape[1]):
            out[:, j] = _draw(self.emission(j)[:, z[:, j]].T, u[:, j])
        return out


def _uniform(ids: np.ndarray, seed: int, width: int) -> np.ndarray:
    return np.stack([np.random.default_rng([seed, int(i) & (2**63 - 1)]).random(width) for i in ids])


def _mapped(rows: DataFrame, seed: int, draws: int, states: int, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            p = len(whole.column(1)[0])
            size = max(1, CELLS // max(1, p * states))
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                ids = batch.column(0).to_numpy()
                x = batch.column(1).flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.int64)
                made = make(x, _uniform(ids, seed, draws * p).reshape(len(ids), draws, p))
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * p)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(made.ravel().astype(np.int32)))], ["row_id", "x", "xko"])

    return rows.select("row_id", "x").mapInArrow(run, "row_id long, x array<int>, xko array<int>")


def markov(rows: DataFrame, start: np.ndarray, transitions: np.ndarray, seed: int = 1) -> DataFrame:
    """(row_id, x, xko) for rows of states 0, 1, ...; transitions: p x S x S, the first unused."""
    shared = rows.sparkSession.sparkContext.broadcast((start, transitions))

    def make(x: np.ndarray, u: np.ndarray) -> np.ndarray:
        q, steps = shared.value
        return chain_controls(x, q, lambda j: steps[j], u[:, 0])

    return _mapped(rows, seed, 1, len(start), make)


def genotypes(rows: DataFrame, model: Haplotypes, seed: int = 1) -> DataFrame:
    """(row_id, x, xko) for rows of genotypes 0, 1, 2, null where missing (-1 in the result): states given x, a control chain, genotypes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make(x: np.ndarray, u: np.ndarray) -> np.ndarray:
        m = shared.value
        z = m.states(x, u[:, 0])
        return m.genotypes(chain_controls(z, m.start(), m.step, u[:, 1]), u[:, 2])

    return _mapped(rows, seed, 3, len(model.a), make)


def read_haplotypes(spark: SparkSession, prefix: str) -> Haplotypes:
    """The model in three text files, a line a variant, numbers apart by white space: prefix_rhat.txt, _alphahat.txt and _thetahat.txt.

    All three fit the driver: a number per variant, or one per variant and haplotype.
    """

    def table(name: str) -> np.ndarray:
        lines = spark.read.text(f"{prefix}_{name}.txt", wholetext=True).first()[0].splitlines()
        return np.array([[float(v) for v in line.split()] for line in lines if line.strip()])

    return Haplotypes(table("rhat").ravel(), table("alphahat"), table("thetahat"))


def write_haplotypes(model: Haplotypes, prefix: str) -> None:
    for name, values in (("rhat", model.r[:, None]), ("alphahat", model.alpha), ("thetahat", model.theta)):
        system, path = plink.opened(f"{prefix}_{name}.txt")
        with system.open_output_stream(path) as f:
            f.write("".join(" ".join(repr(float(v)) for v in line) + "\n" for line in values).encode())


def genotype_files(spark: SparkSession, prefix: str, model: Haplotypes | str, out: str, seed: int = 1) -> DataFrame:
    """From files to files: control genotypes of the triple at prefix, written as a triple at out with .k after the variants' names.

    model: the haplotype model, or the prefix of its files. Returns the controls, (row_id, x, xko).
    """
    model = read_haplotypes(spark, model) if isinstance(model, str) else model
    made = genotypes(plink.by_sample(plink.read(spark, prefix)), model, seed)
    plink.write(plink.by_variant(made, "xko"), plink.variants(spark, prefix), plink.samples(spark, prefix), out, ".k")
    return made
