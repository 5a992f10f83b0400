"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fits below any integer identifier; stands for a null doc_id in sort keys.
NULL_KEY = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What tells a text: its id (null as NULL_KEY) and its hash, so that rows that share an id are judged apart.
KEY = ("_id", "_text")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *KEY) of docs, and more columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", *more).withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)), "_text": F.xxhash64(text)})


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local one stands in only where that is unset and there is one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints/mirrorfield"


#: Folders that hold written tables, by session.
_written: dict[str, list[str]] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again, so that lost executors cost no recomputation and plans stay short.

    A table, not checkpoint(): that keeps the plan's constraints, which grow from round to round in loops of joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes the tables that checkpointed wrote; frames that read them must have been written by then."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        removed(spark, path)


def join_skewed(rows: DataFrame, of: DataFrame, key: str | list[str], n: str, heavy: int = 1024) -> DataFrame:
    """rows joined with of, a row per key, of one or more columns, that counts the key's rows in column n, which is dropped.

    Keys that have over 1 / heavy of all rows each, fewer than heavy, are broadcast to where their rows lie; the others meet by shuffling.
    """
    of = checkpointed(of)
    many = F.broadcast(of.where(F.col(n) * heavy > of.agg(F.sum(n)).scalar()).drop(n))
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(of.drop(n), key))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string or binary column as one uint8 array, and n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(column) and data is not None else np.empty(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


#: Bytes of a batch of rows that goes to a Python worker, but for its last row. It lies in the JVM, where it grows by doubling, and in the worker, for each task.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python workers in batches of about BATCH_BYTES, not of 10,000 rows whatever their size. A limit that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


#: glibc keeps what numpy has freed, in idle workers too, unless it is told not to; other C libraries have no such function.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1024, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """The batches' rows, at most so many and, but for single rows, of so many bytes at a time. Freed memory is given back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            parts = [batch.slice(at, rows)]
            while parts:
                part = parts.pop()
                if part.num_rows > 1 and part.nbytes > size:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
    _trim(0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node reachable.

    Rounds of contraction: each node points at the smallest of itself and its neighbours, pointers are followed
    to their ends by doubling, and edges are drawn anew between the ends. Each round at least halves the nodes,
    so both loops are logarithmic; only counts reach the driver. Empty edges give no rows; loops are ignored.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        while True:
            ends = to.select(F.col("node").alias("root"), F.col("root").alias("end"))
            further = checkpointed(to.join(ends, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")))
            to = further.select("node", "root")
            if not further.where("moved").take(1):
                break
        maps.append(to)
        for side in ("a", "b"):
            edges = edges.join(to.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("root", side)
        edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0]
    for later in maps[1:]:
        found = found.join(later.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return found
