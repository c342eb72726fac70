"""Counting and valid records of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergestone.schemas import DELETE, PUT


def counting_records(wal_entry: DataFrame) -> DataFrame:
    """Puts and deletes with a key; a null term is term 0. Records without a store or an index can't be placed and are left out."""
    return wal_entry.where(F.col("op_type").isin(PUT, DELETE) & F.col("key_bytes").isNotNull() & F.col("store_id").isNotNull() & F.col("log_index").isNotNull()).withColumn("term", F.coalesce("term", F.lit(0).cast("long")))


def micros(column: str) -> Column:
    """A time column as microseconds since 1970 on its own clock, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def valid_records(wal_entry: DataFrame, arrival: bool = False) -> DataFrame:
    """One row for each (store_id, log_index): the counting record of the greatest term, whatever its copies' number and order.

    Should records of one term differ, the one that arrived first counts (with ``arrival``), then the greater type,
    key and value. ``arrival`` adds ``arrived_us``, the least arrival time of the record's copies in microseconds.

    One shuffle by (store, index); copies are combined before it.
    """
    rows = counting_records(wal_entry)
    record = ["op_type", "key_bytes", "value_bytes"]
    early = [(-micros("arrived_at")).alias("early")] if arrival else []
    best = rows.select("store_id", "log_index", F.struct("term", *early, *record).alias("r")).groupBy("store_id", "log_index").agg(F.max("r").alias("r"))
    return best.select("store_id", "log_index", "r.term", *[f"r.{c}" for c in record], *([(-F.col("r.early")).alias("arrived_us")] if arrival else []))
