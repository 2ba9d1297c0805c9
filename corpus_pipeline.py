"""The corpus pipeline: from `documents` to sharded training rows. Each stage reads what the one before it wrote as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm import decontam, mixing, sharding, skipjoin, toxicity
from reelwright.llm.common import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on `labels`, scores at 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each class of near copies: 0.8 of their shingles of five words are shared."""
    return skipjoin.keep_one(docs, n=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs."""
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to fill the sources' targets, in the order of their training positions."""
    return mixing.mixed_rows(docs)


def written_order(docs: DataFrame) -> tuple[Column, Column]:
    """(number of the task, (number of its file, place in it)) of rows read from a range-sorted Parquet table: the order in which they were
    written. A task that writes several files, as with a limit of records in a file, numbers them."""
    part = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("long")
    return part(r"part-(\d+)"), F.struct(part(r"-c(\d+)\.").alias("file"), F.col("_metadata.row_index").alias("row"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; a shard's slots rise in the order of the training positions that the stage before gave."""
    return sharding.shard_documents(docs, whole=True, order=written_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained classifier, which SQL can't express; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: the columns of documents, then size, text_crc32, law, shard, slot and grown_shard; a row for each time that
    the mix takes a document.

    Null and empty texts are not toxic, are copies of nothing and have no benchmark passage; having no words, they are taken 0 times by the
    mix. Null doc_ids, sources and other columns go through. Rows that repeat a doc_id and text are one document to the near-duplicate
    stage. Very long texts are read whole by every stage. More columns go through, whatever their names (the last stage adds "_in" to those
    that it has itself). Empty tables of documents, labels or benchmark items give an empty result, a classifier that rejects nothing, or no
    passages.
    """
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
