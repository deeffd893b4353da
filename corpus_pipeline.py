"""The corpus pipeline: five stages from documents to packed windows, each written as Parquet and read again.

Every stage takes null keys, texts and sources, empty and very long texts, ties, repeated rows, empty tables and further
columns of any name; all but the last return the columns that they were given.

A stage bounds the batches in which the session sends rows to Python, unless the session has a limit: executors
that go through all stages keep what large batches took outside the heap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, ngram_join, packing, passages, toxicity
from tessella.llm.common import bound_batches, new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models, fitted on these documents and their labels, don't reject.

    Null and empty texts are kept, since the models give them what the bias gives; rows with null keys are judged like
    others but never learned from; repeated rows go or stay together; without labels nothing is rejected.
    """
    bound_batches(spark)
    models = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, models)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by 5-word shingles at a similarity of 0.8.

    Null and empty texts link with nothing, so all of them stay; a null key is the largest, and of rows repeating the
    smallest key within a group one stays.
    """
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document that has them.

    Null, empty and short texts stay as they are; a null key is the largest; of repeated rows of 50 words and more one
    stays; a document of which nothing is left goes; n_chars is counted anew.
    """
    bound_batches(spark)
    return passages.cut_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice is two rows.

    A null source is a source of its own; null and empty texts have no words, and are taken as their hash says; repeated
    rows are taken equally often.
    """
    whole = docs.select("doc_id", "text", "source", F.struct("*").alias("_record"))
    mixed = mixing.mix_sources(whole, keep=("_record",)).where("copies > 0")
    return mixed.select("_record", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select("_record.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens: the result's columns are those of packing.pack.

    Each row is packed as often as it is there; a null or empty text is the end token alone; null keys are kept.
    """
    bound_batches(spark)
    return packing.pack(docs, packing.default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_near_copy),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]
#: No SQL expresses fitted models, near-duplicate search or tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
