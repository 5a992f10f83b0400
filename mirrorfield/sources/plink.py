"""Genotype triples: .bed (two bits a genotype, variant by variant), .bim and .fam (text, no header)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: First bytes of a variant-major file; the two-bit codes of 0, missing, 1 and 2 copies are 0, 1, 2 and 3. Fixed values of the format.
MAGIC = b"\x6c\x1b\x01"
_DECODED = np.array([0, -1, 1, 2], np.int8)
_CODED = np.array([0, 2, 3, 1], np.uint8)
SCHEMA = "variant_id long, g array<tinyint>"
BIM = "chrom string, snp_id string, cm double, pos long, a1 string, a2 string"
FAM = "family string, sample string, father string, mother string, sex int, phenotype string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def made_folder(path: str) -> None:
    system, where = opened(path)
    system.create_dir(where, recursive=True)


def removed_folder(path: str) -> None:
    system, where = opened(path)
    system.delete_dir(where)


def _numbered(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Lines with their number. A file is read as one split, so that numbers are those of the lines."""
    table = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n\r ")), "\r?\n")).alias(key, "line"))
    parts = F.split(F.trim("line"), r"\s+")
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return table.select(F.col(key).cast("long").alias(key), *[F.get(parts, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def variants(spark: SparkSession, prefix: str) -> DataFrame:
    return _numbered(spark, prefix + ".bim", BIM, "variant_id")


def samples(spark: SparkSession, prefix: str) -> DataFrame:
    return _numbered(spark, prefix + ".fam", FAM, "sample_id")


def _decoded(f, first: int, many: int, n: int) -> pa.RecordBatch:
    """Genotypes of n samples at many variants from first on, null where missing."""
    width = (n + 3) // 4
    f.seek(len(MAGIC) + first * width)
    raw = np.frombuffer(f.read(many * width), np.uint8).reshape(many, width)
    flat = _DECODED[(raw[:, :, None] >> np.arange(0, 8, 2, dtype=np.uint8)) & 3].reshape(many, -1)[:, :n].ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * n), pa.array(flat, mask=flat < 0))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + many)), lists], ["variant_id", "g"])


def _variants_in(prefix: str, n: int) -> int:
    """The number of variants of a .bed of n samples; an error if it isn't one."""
    system, path = opened(prefix + ".bed")
    total, rest = divmod(system.get_file_info(path).size - len(MAGIC), max((n + 3) // 4, 1))
    with system.open_input_file(path) as f:
        if f.read(len(MAGIC)) != MAGIC or rest:
            raise ValueError(f"not a variant-major file of {n} samples: {path}")
    return total


def read(spark: SparkSession, prefix: str, per_task: int = 1024) -> DataFrame:
    """(variant_id, g array<tinyint>): genotypes of all samples, null where missing; each task reads its range of variants."""
    n = samples(spark, prefix).count()
    total = _variants_in(prefix, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(prefix + ".bed")
        with system.open_input_file(path) as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    yield _decoded(f, first, min(per_task, total - first), n)

    return spark.range(0, total, per_task, max(1, -(-total // per_task))).mapInArrow(run, SCHEMA)


class Genotypes(DataSource):
    """spark.read.format("genotypes").load(prefix), after spark.dataSource.register(Genotypes): what read gives, as a data source.

    Option perTask: variants that a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "genotypes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("perTask", 1024)))


class _Reader(DataSourceReader):
    def __init__(self, prefix: str, per_task: int):
        self.prefix, self.per_task = prefix, per_task
        system, path = opened(prefix + ".fam")
        with system.open_input_stream(path) as f:
            self.n = sum(1 for line in f.read().splitlines() if line.strip())
        self.total = _variants_in(prefix, self.n)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(first) for first in range(0, self.total, self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, path = opened(self.prefix + ".bed")
        with system.open_input_file(path) as f:
            yield _decoded(f, partition.value, min(self.per_task, self.total - partition.value), self.n)


def without_missing(variants: DataFrame) -> DataFrame:
    """(variant_id, g) with 0 for missing genotypes."""
    return variants.withColumn("g", F.transform("g", lambda v: F.when(v < 0, None).otherwise(v)).cast("array<tinyint>")).withColumn("g", F.transform("g", lambda v: F.coalesce(v, F.lit(0).cast("tinyint"))))


def by_sample(variants: DataFrame) -> DataFrame:
    """(row_id, x array<int>): the same, a row a sample."""
    long = variants.select("variant_id", F.posexplode("g").alias("row_id", "v"))
    return long.groupBy(F.col("row_id").cast("long").alias("row_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("variant_id", "v"))), lambda s: s["v"].cast("int")).alias("x"))


def by_variant(rows: DataFrame, column: str = "x") -> DataFrame:
    """(variant_id, g) of (row_id, x), samples in order of row_id."""
    long = rows.select("row_id", F.posexplode(column).alias("variant_id", "v"))
    return long.groupBy(F.col("variant_id").cast("long").alias("variant_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "v"))), lambda s: s["v"].cast("tinyint")).alias("g"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once; a column that a lambda mentions is evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scaled(v: Column, mean: Column, sd: Column) -> Column:
    return F.when(mean.isNull(), None).when(sd > 0, F.coalesce(F.when(v >= 0, v - mean), F.lit(0.0)) / sd).otherwise(F.lit(float("nan")))


def standardised(g: Column) -> Column:
    """A variant's genotypes, missing ones at the mean, centred and scaled (n - 1): NaN without spread, null if all are missing."""
    known = F.filter(g, lambda v: v >= 0)
    mean = _let(known, lambda k: F.aggregate(k, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(k), F.lit(0)))
    square = lambda m: F.aggregate(g, F.lit(0.0), lambda s, v: s + F.coalesce(F.when(v >= 0, (v - m) * (v - m)), F.lit(0.0)))
    sd = lambda m: F.sqrt(square(m) / F.nullif(F.size(g) - 1, F.lit(0)))
    return _let(mean, lambda m: _let(sd(m), lambda d: F.transform(g, lambda v: _scaled(v, m, d))))


def spread(genotypes: DataFrame) -> DataFrame:
    """(variant_id, mean, sd) of (variant_id, g), a row a genotype: the mean of the known ones, and the deviation (n - 1) with missing ones at the mean."""
    known = F.when(F.col("g") >= 0, F.col("g").cast("long"))
    sums = genotypes.groupBy("variant_id").agg(F.count("*").alias("n"), F.count(known).alias("k"), F.coalesce(F.sum(known), F.lit(0)).alias("s"), F.coalesce(F.sum(known * known), F.lit(0)).alias("q"))
    k, s, q = [F.col(c).cast("decimal(19,0)") for c in ("k", "s", "q")]
    # whole numbers until here, so that nothing cancels
    square = (k * q - s * s).cast("double") / F.nullif(F.col("k"), F.lit(0))
    return sums.select("variant_id", (F.col("s") / F.nullif(F.col("k"), F.lit(0))).alias("mean"), F.sqrt(square / F.nullif(F.col("n") - 1, F.lit(0))).alias("sd"))


def standardised_rows(genotypes: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """genotypes (variant_id, g, ...), a row a genotype, with x as standardised gives it. by: their spread, such as one that is to be broadcast."""
    by = (spread(genotypes) if by is None else by).select(F.col("variant_id").alias("_variant"), F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))
    return genotypes.join(by, F.col("variant_id").eqNullSafe(F.col("_variant"))).select(*genotypes.columns, _scaled(F.col("g"), F.col("_mean"), F.col("_sd")).alias("x"))


def write(variants_g: DataFrame, bim: DataFrame, fam: DataFrame, prefix: str, suffix: str = "") -> None:
    """The triple; suffix goes to each variant's name, such as .k for control copies. Tasks pack four genotypes a byte; a .bed is one file, so the driver
    writes it, from one task's packed variants after the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for row in batch.column(1):
                g = row.values.fill_null(-1).to_numpy().astype(np.int64)
                codes = np.zeros(-(-len(g) // 4) * 4, np.uint8)
                codes[: len(g)] = _CODED[g]
                packed.append(np.bitwise_or.reduce(codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8), axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["variant_id", "packed"])

    system, path = opened(prefix + ".bed")
    with system.open_output_stream(path) as f:
        f.write(MAGIC)
        for row in variants_g.select("variant_id", "g").mapInArrow(run, "variant_id long, packed binary").orderBy("variant_id").toLocalIterator():
            f.write(bytes(row.packed))
    names = bim.orderBy("variant_id").withColumn("snp_id", F.concat("snp_id", F.lit(suffix)))
    for table, key, ending in ((names, "variant_id", ".bim"), (fam.orderBy("sample_id"), "sample_id", ".fam")):
        system, path = opened(prefix + ending)
        with system.open_output_stream(path) as f:
            for row in table.drop(key).toLocalIterator():
                f.write(("\t".join(f"{v:g}" if isinstance(v, float) else str(v) for v in row) + "\n").encode())
