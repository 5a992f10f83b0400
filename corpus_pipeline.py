"""A corpus from documents: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfield.llm import decontaminate, mixing, simhash, suffix_dedup, toxicity
from mirrorfield.llm.common import clear, removed, shared_folder, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. Null and empty texts stay; without labels all stay. Repeated rows go or stay together."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays.

    Texts without words, null ones too, are copies of each other, so one of them stays. Null ids come last; rows that share an id are told by their texts.
    """
    small_batches(spark)
    return simhash.keep_one(docs.select(*COLUMNS), width=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also start earlier are cut out of the texts; documents of which nothing is left go.

    A cut within a character takes the whole character. n_chars is counted anew; documents that were empty before stay, with an empty
    text for a null one. Texts under 100 bytes stay whole.
    """
    small_batches(spark)
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), keep=["lang", "source", "n_chars"], characters=True)
    rows = cut.where((F.col("n_bytes") == 0) | (F.length("kept") > 0)).withColumn("text", F.col("kept").cast("string"))
    return rows.select("doc_id", "text", "lang", "source", F.when(F.size("starts") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; without items, and of null and empty texts, all stay."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their place in the mixture by mixing.WEIGHTS: ordered by (mix_slot, mix_offset). All stay, repeated rows too."""
    return mixing.mix(docs.select(*COLUMNS), mixing.WEIGHTS).select(*COLUMNS, "mix_block", "mix_slot", "mix_offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
]

#: Fitted weights, links and repeats aren't SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet in the folder that the cluster shares, and read again; then what it was made from goes."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{home}/{name.replace(' ', '_')}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark)
        if before:
            removed(spark, before)
        before = path
    return docs
