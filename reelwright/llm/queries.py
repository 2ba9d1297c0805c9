"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm import decontam, divergence, language, mixing, pii, quality, quantiles, sharding, skipjoin, syncmers, toxicity, warc, wrapper
from reelwright.llm.common import table


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_skipjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipjoin.link_classes(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind the spans of its pattern are counted; those that the field adds are in `spans` and n_added."""
    rows = pii.find(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[F.col(f"base_{k}").alias(f"n_{k}") for k in pii.KINDS], "base_sha256", "spans", "n_added")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op13_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.stream_quantiles(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_syncmers, op2_skipjoin, op3_language, op4_sharding, op5_decontam, op6_toxicity, op7_pii, op8_warc, op9_wrapper, op10_mixing, op11_divergence, op12_quality, op13_quantiles)}


def oracle_sql() -> dict[str, str]:
    return {"op2_skipjoin": skipjoin.SQL, "op4_sharding": sharding.SQL, "op5_decontam": decontam.SQL, "op8_warc": warc.SQL, "op10_mixing": mixing.SQL, "op11_divergence": divergence.SQL, "op13_quantiles": quantiles.SQL}
