"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two; the bit counts of the segments (0, 1 or 2) are its embedding. The
Manhattan distance of two embeddings never exceeds the number of differing bits, so it bounds the join from below.
The embedding is cut into six blocks. Embeddings within distance 3 differ in at most three blocks, so they share
one of the twenty grid cells that fix the coordinates of three blocks: the range join is an equi-join on cells.
Within a cell the Manhattan bound is tested first, then the differing bits exactly. A cell of many fingerprints is cut
finer: of four parts of the coordinates that it leaves open one at least is the same, so each part that is fixed too
gives one of four finer cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfield.llm import jaccard
from mirrorfield.llm.common import checkpointed, components, join_skewed, pieces, table

RADIUS = 3
#: Segments (of two bits) in each of the six blocks of the embedding.
BLOCKS = ((0, 5), (5, 10), (10, 15), (15, 20), (20, 26), (26, 32))
#: Cells of more fingerprints are cut finer, DEPTH times; then by their bits, where 16 ** RADIUS fingerprints share a cell at most.
CELL_LIMIT, DEPTH = 4096, 3
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(votes: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * votes > n, bitorder="little")


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half the shingles' hashes, repeats included. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = words if width == 1 else list(map(b" ".join, zip(*(words[i:] for i in range(width))))) or [b" ".join(words)]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        hashes = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
        votes += _votes(hashes)
    return int(_majority(votes, len(shingles)).view(np.uint64)[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """The signed fingerprint of a set of shingles' hashes, each counted once; of none: 0."""
    votes = sum((_votes(hashes[at : at + _CHUNK]) for at in range(0, len(hashes), _CHUNK)), np.zeros(64, np.int64))
    return int(_majority(votes, len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.fromiter((fingerprint(t or b"", width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embed(prints: np.ndarray) -> np.ndarray:
    """Segment counts in unary: two bits a segment, so that differing bits of two codes are their Manhattan distance."""
    low = np.uint64(0x5555555555555555)
    a, b = prints & low, (prints >> np.uint64(1)) & low
    return (a | b) | ((a & b) << np.uint64(1))


def _masks() -> list[list[list[int]]]:
    """By level the segments that each cell fixes; cell w of a level is cut into 4 w, ... 4 w + 3 of the next."""
    levels = [[[i for start, end in chosen for i in range(start, end)] for chosen in combinations(BLOCKS, len(BLOCKS) - RADIUS)]]
    for _ in range(DEPTH):
        finer = []
        for fixed in levels[-1]:
            open_ = [i for i in range(32) if i not in fixed]
            finer += [fixed + open_[part :: RADIUS + 1] for part in range(RADIUS + 1)]
        levels.append(finer)
    return levels


def _lit(segments: list[int]) -> Column:
    return F.lit(_signed(sum(3 << 2 * i for i in segments)))


def _cells(prints: DataFrame, masks: list[list[int]]) -> DataFrame:
    """The cells of each fingerprint: (which, cell, fp, code)."""
    low = F.lit(0x5555555555555555)
    a, b = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    coded = prints.select("fp", a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1)).alias("code"))
    cells = F.array(*[F.struct(F.lit(i).alias("which"), F.col("code").bitwiseAND(_lit(m)).alias("cell")) for i, m in enumerate(masks)])
    return coded.select(F.explode(cells).alias("c"), "fp", "code").select("c.which", "c.cell", "fp", "code")


def _finer(cells: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Each cell's fingerprints in the four finer cells."""
    inner = F.sequence(F.col("which") * (RADIUS + 1), F.col("which") * (RADIUS + 1) + RADIUS)
    of = cells.select(F.explode(inner).alias("which"), "fp", "code")
    return of.select("which", F.col("code").bitwiseAND(F.get(F.array(*map(_lit, masks)), F.col("which"))).alias("cell"), "fp", "code")


def _bit_cells(prints: DataFrame) -> DataFrame:
    """Cells that fix thirteen of the sixteen groups of four bits, for fingerprints whose embeddings are all alike."""
    groups = [0xF << 4 * i for i in range(16)]
    masks = [sum(chosen) for chosen in combinations(groups, 16 - RADIUS)]
    listed = F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m, i: F.struct(i.alias("which"), F.col("fp").bitwiseAND(m).alias("cell")))
    return prints.select(F.explode(listed).alias("c"), "fp").select("c.which", "c.cell", "fp")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is linked, one fewer than members: breadth first, Manhattan bound before exact bits."""
    codes, rest, links = embed(prints), np.arange(len(prints)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(codes[rest] ^ codes[i]) <= RADIUS
            near[near] = np.bitwise_count(prints[rest[near]] ^ prints[i]) <= RADIUS
            found, rest = rest[near], rest[~near]
            links += [(i, j) for j in found]
            queue += list(found)
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell -> spanning links (a, b) of each cell. Carries one cell, of bounded size, between batches."""
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3

    def solve(which: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (which[1:] != which[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        u = fp.view(np.uint64)
        two = starts[sizes == 2]
        two = two[np.bitwise_count(embed(u[two]) ^ embed(u[two + 1])) <= RADIUS]
        two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= RADIUS]
        a, b = [fp[two]], [fp[two + 1]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if links := _forest(u[at : at + n]):
                pairs = np.array(links) + at
                a.append(fp[pairs[:, 0]])
                b.append(fp[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        now = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero(np.r_[True, (now[1][1:] != now[1][:-1]) | (now[0][1:] != now[0][:-1])])[-1])
        held = [c[last:] for c in now]
        if last:
            yield solve(*(c[:last] for c in now))
    if len(held[0]):
        yield solve(*held)


def _linked(cells: DataFrame) -> DataFrame:
    return cells.select("which", "cell", "fp").repartition("which", "cell").sortWithinPartitions("which", "cell").mapInArrow(_links, "a long, b long").where("a <> b").distinct()


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect all that differ in RADIUS bits or fewer.

    Within a cell, spanning links stand for all pairs. Cells of over CELL_LIMIT fingerprints are cut finer.
    """
    levels = _masks()
    cells, links = _cells(prints, levels[0]), None
    for finer in [*levels[1:], None]:
        hot = checkpointed(cells.groupBy("which", "cell").count().where(F.col("count") > CELL_LIMIT).select("which", "cell"))
        if not hot.take(1):
            found = _linked(cells)
            return found if links is None else links.unionByName(found)
        cold = checkpointed(_linked(cells.join(hot, ["which", "cell"], "left_anti")))
        links = cold if links is None else links.unionByName(cold)
        cells = checkpointed(cells.join(hot, ["which", "cell"], "left_semi"))
        cells = _finer(cells, finer) if finer else _bit_cells(cells.select("fp").distinct())
    return links.unionByName(_linked(cells))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable over links.

    Equal fingerprints are one node. Empty, null and blank texts share fingerprint 0. Repeated rows stay, each with
    the same component. A null doc_id stays null and never becomes a component's id unless all members' ids are null.
    Other columns are ignored; no rows give no rows.
    """
    prints = checkpointed(fingerprints(docs, width))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = components(near_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = checkpointed(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    of_root = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(of_root, "root").select("fp", "component_id", "n")
    return join_skewed(prints, by_fp, "fp", "n").select("doc_id", "fp", "component_id")


def near_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the keys of sets (key, fp) that connect all whose fingerprints differ in RADIUS bits or fewer."""
    nodes = checkpointed(sets.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    alike = join_skewed(sets.select("key", "fp"), nodes, "fp", "n").select(F.col("least").alias("a"), F.col("key").alias("b")).where("a <> b")
    of = nodes.select("fp", "least")
    near = near_links(nodes.select("fp")).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return alike.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of docs for each component of shingle sets that are equal or of Jaccard similarity 0.8 or more, exactly.

    Sets are searched by their fingerprints, through the segment-popcount embedding, and the pairs found are verified on the
    texts. 64 bits don't bound a similarity of 0.8, so mirrorfield.llm.jaccard adds the pairs that they miss.

    The row with the smallest doc_id stays, null ids last, ties by the set and a hash of the whole row. Rows are told apart by
    doc_id and that hash, so different texts under one doc_id, or under none, each have a verdict of their own; of rows equal
    in all columns one stays. Texts without words are one component.
    """
    links = jaccard.Links(docs, width, set_fingerprint)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "row")
    # one row a key before anything is joined: copies may be many
    first = links.found.groupBy("key").agg(F.min(order).alias("o"))
    named = first.join(links.roots(near_pairs(links.sets)), "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = named.groupBy("root").agg(F.min("o").alias("o")).select("o.doc_id", "o.row").withColumn("stays", F.lit(True))
    kept = links.found.select("doc_id", "row").distinct().alias("f").join(kept.alias("k"), F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("f.row") == F.col("k.row")), "left")
    gone = checkpointed(kept.where("stays is null").select(F.col("f.doc_id").alias("_id"), F.col("f.row").alias("_gone")))
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_KEYS else gone
    rows = docs.withColumn("_row", jaccard.whole_row(docs))
    stay = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_gone")), "left_anti")
    repeated = links.found.groupBy("doc_id", "row").count().where("count > 1").take(1)
    return (stay.dropDuplicates(["doc_id", "_row"]) if repeated else stay).drop("_row")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
