"""The write-ahead log as a table: segments, next numbers, damage, truncation, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergestone.functions.layout import wal_bytes, wal_payload, wal_record
from mergestone.operators.incremental import marks_in_force


def segments(wal_entry: DataFrame) -> DataFrame:
    """(store_id, segment, records, first_index, last_index, bytes) of what is stored, damaged and repeated records included."""
    return wal_entry.groupBy("store_id", "segment").agg(
        F.count(F.lit(1)).alias("records"), F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"), F.sum(wal_bytes(F.col("key_bytes"), F.col("value_bytes"))).alias("bytes")
    )


def next_numbers(wal_entry: DataFrame) -> DataFrame:
    """(store_id, next_index, next_segment): where an opened log goes on. Each open starts a segment of its own."""
    return wal_entry.groupBy("store_id").agg((F.coalesce(F.max("log_index"), F.lit(0)) + 1).alias("next_index"), (F.coalesce(F.max("segment"), F.lit(0)) + 1).alias("next_segment"))


def is_damaged() -> Column:
    """A record that can't be decoded: no type of the two, or no key."""
    return ~F.coalesce(F.col("op_type").isin(1, 2), F.lit(False)) | F.col("key_bytes").isNull()


def stop_at_damage(wal_entry: DataFrame) -> DataFrame:
    """The records before the first damaged one of their segment, by index; later segments are still read.

    Two steps instead of a window over a segment: the first damage of each segment, then a join with that small table.
    """
    first = wal_entry.where(is_damaged()).groupBy("store_id", "segment").agg(F.min("log_index").alias("first_bad"))
    return wal_entry.join(first, ["store_id", "segment"], "left").where(F.col("first_bad").isNull() | (F.col("log_index") < F.col("first_bad"))).drop("first_bad")


def after_mark(records: DataFrame, wal_meta: DataFrame) -> DataFrame:
    """The records above their store's truncation mark; all of them where there is none."""
    marks = marks_in_force(wal_meta).select("store_id", "truncated_before")
    return records.join(marks, "store_id", "left").where(F.col("truncated_before").isNull() | (F.col("log_index") > F.col("truncated_before"))).drop("truncated_before")


def with_checksum(records: DataFrame) -> DataFrame:
    """Adds the record's bytes on disk and the CRC-32 of its payload."""
    payload = wal_payload(F.col("term"), F.col("log_index"), F.col("op_type"), F.col("key_bytes"), F.col("value_bytes"))
    return records.withColumn("crc32", F.crc32(payload)).withColumn("record", wal_record(payload))
