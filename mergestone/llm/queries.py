"""Queries of problems 7 to 9, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.llm.encoding import encode_documents, token_counts
from mergestone.llm.mojibake import garbled
from mergestone.llm.packing import fill_report, pack


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents. A table of fewer splits than the cluster has cores is spread over them; a larger one is read as it lies."""
    docs, cores = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(_documents(spark, sf))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(token_counts(_documents(spark, sf)))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p8_pack(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled(_documents(spark, sf)).select("doc_id")


def p9_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return garbled(_documents(spark, sf)).select("doc_id", "repaired", "lost", F.col("layers").cast("int").alias("layers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_ids, p8_pack, p8_fill, p9_found, p9_repaired)}

ORACLE_SQL: dict[str, str] = {}
