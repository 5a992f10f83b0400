"""Near copies by the Jaccard similarity of word shingles: every link of SIMILARITY or more, none lost to a sketch.

The first candidates are from SimHash fingerprints of the sets (mirrorfield.llm.simhash). Sixty-four bits don't bound a
Jaccard similarity of 0.8, so for the rest the segment-popcount embedding is of the whole sets: a set of shingle hashes becomes its counts per segment of the hash range. The Manhattan distance of two such
embeddings never exceeds the number of shingles that only one set has, so it bounds the join from below; what passes is
verified exactly, on the texts.

1. Prefix filtering: of two sets of similarity t, the first size - ceil(t * size) + 1 shingles of each, in one order of
   all shingles, share one. Shingles that a sample of the documents has often come last; that sets the cost, never the result.
2. Groups of keys with a common prefix shingle: small ones give their pairs, large ones the pairs with a pivot.
3. These pairs and those of the fingerprints that pass the Manhattan bound are verified and linked; components follow.
4. Large groups whose members are not all in one component by then are searched for further pairs, between members of
   different components only, in blocks of bounded size.

Texts move once if something may link them, and to each pivot that may link them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorfield.llm.common import checkpointed, components, join_skewed, pieces

#: 4 / 5, in whole numbers.
SIMILARITY = (4, 5)
#: Groups of more members give pairs with a pivot only, and what that leaves is searched in blocks of BLOCK members.
GROUP_LIMIT, BLOCK = 8, 256
#: One row in SAMPLE tells which shingles are frequent: FREQUENT times in the sample; at most so many are told to the tasks.
SAMPLE, FREQUENT, MOST_FREQUENT = 32, 3, 100_000
#: Rows of a shingle, as the sample tells, that one task gets; pairs of a pivot that one task verifies.
TASK_ROWS, TASK_PAIRS = 4096, 64
#: Keys (of 24 bytes) that are broadcast to the texts at most; more are joined by shuffling.
BROADCAST_KEYS = 1_000_000
#: Segments of the smallest embedding, and shingles per segment.
SEGMENTS, PER_SEGMENT = 64, 8


def shingle_set(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending; fewer words than width are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    shingles = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def key_of(shingles: np.ndarray) -> int:
    """Equal sets have equal keys."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def embed(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes per segment of their range, 255 at most."""
    bits = SEGMENTS.bit_length() - 1
    while len(shingles) > PER_SEGMENT << bits:
        bits += 1
    return np.minimum(np.bincount((shingles.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _folded(e: np.ndarray, segments: int) -> np.ndarray:
    return np.minimum(e.reshape(segments, -1).sum(1, dtype=np.int64), 255)


def may_link(a: np.ndarray, b: np.ndarray, m: int, n: int) -> bool:
    """Whether the Manhattan distance of two embeddings allows sets of m and n shingles to be linked."""
    size = min(len(a), len(b))
    return int(np.abs(_folded(a, size) - _folded(b, size)).sum()) <= m + n - 2 * needed(m, n)


def needed(m, n):
    """Common shingles that two sets of m and n need."""
    p, q = SIMILARITY
    return -(-p * (m + n) // (p + q))


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); row is a hash of all columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_row(docs).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for piece in pieces([batch]):
            yield piece, [shingle_set(t, width) for t in piece.column(piece.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def keys(texts: DataFrame, width: int, sketch: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, row, key, size, embedding, fp) for each row; fp is the set's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            arrays = [pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([embed(s).tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["doc_id", "row", "key", "size", "embedding", "fp"])

    return texts.mapInArrow(run, "doc_id long, row long, key long, size long, embedding binary, fp long")


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample has often, ascending by their number of rows, and about how many all texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["t"])

    counted = texts.where(F.pmod("row", F.lit(SAMPLE)) == 0).mapInArrow(run, "t long").groupBy("t").count().where(F.col("count") >= FREQUENT)
    found = counted.orderBy(F.desc("count"), "t").limit(MOST_FREQUENT).collect()
    return np.array([r["t"] for r in reversed(found)], np.int64), np.array([r["count"] * SAMPLE for r in reversed(found)], np.int64)


def _prefixes(texts: DataFrame, width: int, last: np.ndarray, rows: np.ndarray) -> DataFrame:
    """(token, salt, key, place): the first shingles of each set, those in last after all others; place is size << 32 | number in the order.

    A shingle of very many rows is dealt to several tasks by salts of 1 and more.
    """
    by_hash = np.argsort(last)
    ranked, salts = last[by_hash], rows[by_hash] // TASK_ROWS + 1
    p, q = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, width):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for s in sets:
                if not len(s) or (key := key_of(s)) in seen:
                    continue
                seen.add(key)
                n, salt = len(s), np.zeros(len(s), np.int64)
                if len(ranked):
                    found = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
                    known = ranked[found] == s
                    order = np.argsort(np.where(known, by_hash[found] + 1, 0), kind="stable")
                    many = np.where(known & (salts[found] > 1), salts[found], 0)
                    salt = np.where(many > 0, 1 + (key & (2**63 - 1)) % np.maximum(many, 1), 0)[order]
                    s = s[order]
                n = n - -(-p * n // q) + 1
                for column, values in zip(out, (s[:n], salt[:n], np.full(n, key), len(s) << 32 | np.arange(n))):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["token", "salt", "key", "place"])

    return texts.mapInArrow(run, "token long, salt long, key long, place long")


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Whole groups of rows sorted by the first columns, many groups at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if not len(held[0]):
            continue
        same = np.logical_and.reduce([c == c[-1] for c in held[:by]])
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            yield [c[:last] for c in held]
            held = [c[last:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _fits(place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes, and what is left from the common shingle on, allow a link; the first common one always does."""
    size = place >> 32
    left = size - (place & 0xFFFFFFFF)
    return np.minimum(left[i], left[j]) >= needed(size[i], size[j])


_FOUND = "token long, key long, other long, place long"


def _candidates(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Prefix rows sorted by (token, salt, key) -> pairs (null, key, other, null) of small groups; of large and salted ones each
    member with the group's pivot: (token, key, pivot, place)."""
    for token, salt, key, place in _groups(batches, 2):
        once = _starts([token, salt, key])
        token, salt, key, place = token[once], salt[once], key[once], place[once]
        starts = _starts([token, salt])
        sizes = np.diff(np.r_[starts, len(token)])
        small, pairs = (sizes > 1) & (sizes <= limit) & (salt[starts] == 0), []
        for n in range(2, limit + 1):
            at = starts[small & (sizes == n)]
            i, j = np.triu_indices(n, 1)
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            good = _fits(place, i, j)
            pairs.append(np.stack([key[i[good]], key[j[good]]]))
        large = (sizes > limit) | (salt[starts] > 0)
        member, pivot = np.repeat(large, sizes), np.repeat(key[starts], sizes)
        # keys are in order within a group, so a pair is always given the same way round
        a, b = np.unique(np.concatenate(pairs, 1), axis=1) if pairs else np.empty((2, 0), np.int64)
        none = pa.nulls(len(a), pa.int64())
        columns = zip((none, pa.array(a), pa.array(b), none), (token[member], key[member], pivot[member], place[member]))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.array(y)]) for x, y in columns], ["token", "key", "other", "place"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, m, n, embedding of a, of b) -> the pairs (a, b) that the Manhattan bound allows."""
    for batch in pieces(batches):
        m, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        x, y = ([np.frombuffer(e, np.uint8) for e in batch.column(i).to_pylist()] for i in (4, 5))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(list(map(may_link, x, y, m, n)), pa.bool_()))


def _crossing(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """(token, i, j, key, root, place, main, embedding) sorted by (token, i, j, key) -> pairs of different roots, not both of the main one,
    that sizes and the Manhattan bound allow; nearest: of each member outside the main root the nearest one only."""
    for token, i, j, key, root, place, main, embedding in _groups(batches, 3):
        ends = np.r_[(starts := _starts([token, i, j])), len(token)]
        a, b = [], []
        for start, end in zip(ends, ends[1:]):
            size, e = place[start:end] >> 32, [np.frombuffer(x, np.uint8) for x in embedding[start:end]]
            least = min(map(len, e))
            folded = np.stack([_folded(x, least) for x in e])
            outside = np.flatnonzero(~main[start:end].astype(bool))
            for x in outside:
                # a pair outside the main root is looked at from its earlier member
                rest = np.flatnonzero((root[start:end] != root[start + x]) & (main[start:end].astype(bool) | nearest | (np.arange(end - start) > x)))
                rest = rest[_fits(place[start:end], np.full(len(rest), x), rest)]
                far, most = np.abs(folded[rest] - folded[x]).sum(1), size[rest] + size[x] - 2 * needed(size[rest], size[x])
                rest = rest[far <= most]
                if nearest and len(rest):
                    far = np.array([np.abs(_folded(e[x], n := min(len(e[x]), len(e[y]))) - _folded(e[y], n)).sum() / (size[x] + size[y]) for y in rest])
                    rest = rest[[far.argmin()]]
                for y in rest:
                    if may_link(e[x], e[y], size[x], size[y]):
                        a.append(key[start + x])
                        b.append(key[start + y])
        if a:
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["key", "packed"])


def _verified(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(a, salt, b, packed) sorted so, a's own text first, without b -> the pairs that are linked. Holds one set of a and one of b."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, own = None, np.empty(0, np.int64)
    for batch in pieces(batches):
        a, b = [], []
        for x, y, packed in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            s = shingle_set(unpack(packed), width)
            if y is None:
                now, own = x, s
            elif now == x and len(np.intersect1d(own, s, assume_unique=True)) >= needed(len(own), len(s)):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class Links:
    """Links of the rows of docs, found once; found is (doc_id, row, key), a row for each."""

    def __init__(self, docs: DataFrame, width: int, sketch: Callable[[np.ndarray], int], limit: int | None = None):
        self.texts, self.width, self.limit = texts_of(docs), width, GROUP_LIMIT if limit is None else limit
        every = checkpointed(keys(self.texts, width, sketch))
        self.found = every.select("doc_id", "row", "key")
        self.sets = every.where("size > 0").groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("at"), F.first("size").alias("size"), F.first("embedding").alias("embedding"), F.first("fp").alias("fp"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, by the bound and then by the texts."""
        of = self.sets.select("key", "size", "embedding")
        x, y = of.toDF("a", "m", "x"), of.toDF("b", "n", "y")
        near = pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_bounded, "a long, b long")
        near = checkpointed(near)
        wanted = checkpointed(near.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(self.sets, "key").select("key", "at.doc_id", "at.row"))
        wanted = wanted.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
        texts = self.texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select("key", "text")
        texts = checkpointed(texts.mapInArrow(_packed, "key long, packed binary").dropDuplicates(["key"]))
        many = near.groupBy("a").agg(F.ceil(F.count("*") / TASK_PAIRS).alias("salts"))
        own = texts.join(many, F.col("key") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "packed")
        others = near.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b").join(texts.select(F.col("key").alias("b"), "packed"), "b").select("a", "salt", "b", "packed")
        rows = own.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return rows.mapInArrow(partial(_verified, width=self.width), "a long, b long").distinct()

    def roots(self, near: DataFrame) -> DataFrame:
        """(key, root) of the keys that have a link; near: pairs (a, b) that the sketches found, which are verified like all others."""
        last, rows = _frequent(self.texts, self.width)
        prefixes = _prefixes(self.texts, self.width, last, rows).repartition("token", "salt").sortWithinPartitions("token", "salt", "key")
        found = checkpointed(prefixes.mapInArrow(partial(_candidates, limit=self.limit), _FOUND))
        pairs = found.where("key <> other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
        links = checkpointed(self.linked(near.unionByName(pairs).distinct()))
        first = checkpointed(components(links).withColumnRenamed("node", "key"))
        members = found.where("token is not null").select("token", "key", "place")
        if not members.take(1):
            return first
        # the nearest member of another component links most of what can be linked; all pairs of what is left then are few
        for nearest in (True, False):
            links = checkpointed(links.unionByName(self.linked(self.crossing(members, first, nearest))))
            first = checkpointed(components(links).withColumnRenamed("node", "key"))
        return first

    def crossing(self, members: DataFrame, roots: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of members (token, key, place) of a token that are in different components. Of each token the largest component's
        members meet only the others, in blocks."""
        placed = checkpointed(members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
        counts = placed.groupBy("token", "root").agg(F.count("*").alias("n"))
        shape = counts.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all")).where("roots > 1")
        shape = shape.select("token", F.col("main.root").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("k"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("l"), "all")
        placed = join_skewed(placed, shape, "token", "all").withColumn("main", F.col("root") == F.col("main"))
        block = F.when(F.col("main"), F.pmod(F.xxhash64("key"), F.col("k"))).otherwise(F.col("k") + F.pmod(F.xxhash64("key"), F.col("l")))
        # a block of the main component meets the l blocks of the others; those meet all
        meets = F.when(F.col("main"), F.sequence(F.col("k"), F.col("k") + F.col("l") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") + F.col("l") - 1))
        dealt = placed.withColumn("own", block).withColumn("met", F.explode(meets)).withColumns({"i": F.least("own", "met"), "j": F.greatest("own", "met")})
        dealt = dealt.join(self.sets.select("key", "embedding"), "key").select("token", "i", "j", "key", "root", "place", "main", "embedding")
        rows = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "key")
        return rows.mapInArrow(partial(_crossing, nearest=nearest), "a long, b long").distinct()
