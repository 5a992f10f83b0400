"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and the beginnings, of four to seven letters, of longer words, hashed.
Its score is
    sigmoid(bias + sum of weights + sum over pairs of terms of the inner product of their factors),
so a pair, such as an insult with the mention of a group, can count for more than its parts. The pair sum needs one
pass: half the difference of the squared sum and the sum of squares of the factors.

Only terms that tell the labels apart have weights, by themselves or with another one of the most frequent terms; the
others would fit the noise of a few thousand rows. The model is fitted on the driver, by adaptive gradient steps, to a
bounded sample of the labelled rows; then each text is scored whole, by itself, where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfield.llm.common import checkpointed, pieces, table

BITS = 18
FACTORS = 4
#: At most so many rows of each label are learned from: those with the lowest hash of their id.
SAMPLE = {1: 3000, 0: 6000}
EPOCHS = 60
RATE = 0.1
BEGINNINGS = (4, 5, 6, 7)
#: Terms of fewer learned rows have no weight, nor have those whose share of the toxic rows is less than so many standard errors from that of the others.
MIN_ROWS, TELLS = 3, 3.0
#: Pairs of so many of the most frequent terms are looked at, too; so many standard errors, as pairs are many.
PAIRED, PAIR_TELLS = 512, 5.5
THRESHOLD = 0.3
#: Words whose terms a worker keeps at most.
KEPT = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def _terms(word: str) -> tuple[int, ...]:
    every = [word, *[f"{k}+{word[:k]}" for k in BEGINNINGS if len(word) > k]]
    return tuple(xxhash.xxh32_intdigest(t.encode()) & ((1 << BITS) - 1) for t in every)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(text: str) -> np.ndarray:
    """Numbers of a text's distinct terms, ascending."""
    found: set[int] = set()
    for word in words_of(text):
        found.update(_terms(word))
    return np.array(sorted(found), np.int32)


@dataclass
class Model:
    """weights and factors of the kept terms, whose numbers ascend."""

    bias: float
    kept: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self.place = {int(t): i for i, t in enumerate(self.kept)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return Model, (self.bias, self.kept, self.weights, self.factors)

    def places(self, text: str) -> list[int]:
        """Where the text's distinct kept terms are."""
        found: set[int] = set()
        known, place = self.known, self.place
        for word in words_of(text):
            have = known.get(word)
            if have is None:
                if len(known) >= KEPT:
                    known.clear()
                have = tuple(place[t] for t in _terms(word) if t in place)
                if len(word) <= 32:
                    known[word] = have
            if have:
                found.update(have)
        return sorted(found)

    def margins(self, texts: list[str]) -> np.ndarray:
        places = [self.places(t) for t in texts]
        offsets = np.cumsum([0, *map(len, places)])
        terms = np.array([p for x in places for p in x], np.int64)
        k = self.factors.shape[1]
        sums = np.zeros((len(texts), 1 + 2 * k))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            v = self.factors[terms]
            sums[some] = np.add.reduceat(np.c_[self.weights[terms], v, v * v], offsets[some], axis=0)
        return self.bias + sums[:, 0] + 0.5 * (sums[:, 1 : k + 1] ** 2 - sums[:, k + 1 :]).sum(1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30)))


def telling(examples: list[tuple[int, np.ndarray]], min_rows: int = MIN_ROWS, tells: float = TELLS, paired: int = PAIRED, pair_tells: float = PAIR_TELLS) -> np.ndarray:
    """Terms, ascending, that differ between labels by themselves or with another one of the most frequent terms."""
    size = 1 << BITS
    sides = [[t for label, t in examples if label == k] for k in (0, 1)]
    n = [len(x) for x in sides]
    counts = [np.bincount(np.concatenate(x), minlength=size) for x in sides]

    def differ(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
        p = (a + b + 0.5) / (n[0] + n[1] + 1.0)
        return np.abs(a / n[0] - b / n[1]) > most * np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))

    enough = counts[0] + counts[1] >= min(min_rows, n[1])
    kept = np.flatnonzero(enough & differ(*counts, tells))
    common = np.sort(np.argsort(-(counts[0] + counts[1]), kind="stable")[:paired])
    common = common[enough[common]]
    both = []
    for side in sides:
        x = np.zeros((len(side), len(common)), np.float32)
        for i, terms in enumerate(side):
            x[i, np.isin(common, terms)] = 1
        both.append(x.T @ x)
    pairs = differ(*both, pair_tells)
    np.fill_diagonal(pairs, False)
    return np.union1d(kept, common[pairs.any(1)])


def fit(examples: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = 7, rate: float = RATE, l2: float = 1e-5, n_factors: int = FACTORS) -> Model:
    """A model of (label, terms) rows; without rows of both labels it gives all texts the smoothed base rate."""
    rng = np.random.default_rng(seed)
    positive = sum(label for label, _ in examples)
    base = (positive + 0.05) / (len(examples) + 1.0)
    bias = float(np.log(base / (1 - base)))
    if not 0 < positive < len(examples):
        return Model(bias, np.empty(0, np.int64), np.empty(0), np.empty((0, n_factors)))
    used = telling(examples)
    rows = [np.searchsorted(used, terms[np.isin(terms, used)]) for _, terms in examples]
    w, v = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), n_factors))
    g_w, g_v, g_b = np.full(len(used), 1e-2), np.full((len(used), n_factors), 1e-2), 1e-2
    labels = np.array([label for label, _ in examples], np.float64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            lengths = np.array([len(rows[i]) for i in part])
            terms, of = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), lengths)
            mine = v[terms]
            per_row = lambda x: np.bincount(of, x, len(part))
            total = np.stack([per_row(mine[:, f]) for f in range(n_factors)], 1).reshape(len(part), n_factors) if n_factors else np.zeros((len(part), 0))
            margin = bias + per_row(w[terms]) + 0.5 * ((total**2).sum(1) - per_row((mine**2).sum(1)))
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]
            each = error[of]
            d_w = np.bincount(terms, each, len(used)) / len(part) + l2 * w
            g_w += d_w**2
            w -= rate * d_w / np.sqrt(g_w)
            if n_factors:
                down = each[:, None] * (total[of] - mine)
                d_v = np.stack([np.bincount(terms, down[:, f], len(used)) for f in range(n_factors)], 1) / len(part) + l2 * v
                g_v += d_v**2
                v -= 0.2 * rate * d_v / np.sqrt(g_v)
            g_b += (d_b := error.mean()) ** 2
            bias -= rate * d_b / np.sqrt(g_b)
    return Model(float(bias), used, w, v)


def held_out(doc_id) -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model:
    """Learns from rows that are not held out. Rows with null ids or labels are no examples; of repeated labels of a document the largest counts."""
    sample = sample or SAMPLE
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = checkpointed(known)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # a share that holds about four times the sample, so that tasks don't each send the whole of it
    share = {label: min(1.0, 4.0 * n / max(1, counts.get(label, 0))) for label, n in sample.items()}
    low = {label: F.lit(True) if share[label] == 1 else F.xxhash64("doc_id") < int((2 * share[label] - 1) * (1 << 63)) for label in sample}
    chosen = [known.where((F.col("toxic") == label) & low[label]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for label, n in sample.items()]
    picked = reduce(DataFrame.unionByName, chosen)
    # at most sum(sample) rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id").select("toxic", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            terms = [terms_of(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), batch.column(2)], ["toxic", "terms", "doc_id"])

    rows = texts.mapInArrow(run, "toxic int, terms binary, doc_id long").toLocalIterator()
    examples = sorted(((r.doc_id, r.toxic, bytes(r.terms)) for r in rows))
    return fit([(toxic, np.frombuffer(terms, np.int32)) for _, toxic, terms in examples])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row. Null and empty texts have no terms and get the bias's score.

    Only the text is an input. Repeated rows get the same score; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = shared.value.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns. Repeated rows go or stay together; null and empty texts have the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = shared.value.scores([t or "" for t in batch.column(at).cast(pa.string()).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
