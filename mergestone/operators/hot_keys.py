"""Per-key results where a few keys hold most rows (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergestone.operators.offsets import CHUNK_ROWS, chunked_totals, with_split
from mergestone.schemas import DELETE, PUT

MEASURES = ("puts", "deletes", "value_bytes")


def log_measures(wal_entry: DataFrame) -> DataFrame:
    """Rows of the log as (table_name, key_bytes, split, place, measures)."""
    rows, split = with_split(wal_entry, ["key_bytes", "op_type", "value_bytes"])
    puts, deletes = ((F.col("op_type") == t).cast("long") for t in (PUT, DELETE))
    return _measured(rows, "wal_entry", split, puts, deletes)


def put_measures(kvpair_put: DataFrame) -> DataFrame:
    """Incoming writes in the same shape; a tombstone is a delete, a null flag neither."""
    rows, split = with_split(kvpair_put, ["key_bytes", "tombstone", "value_bytes"])
    return _measured(rows, "kvpair_put", split, (~F.col("tombstone")).cast("long"), F.col("tombstone").cast("long"))


def _measured(rows: DataFrame, name: str, split: list[Column], puts: Column, deletes: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("table_name"), "key_bytes", *split, puts.alias("puts"), deletes.alias("deletes"), F.octet_length("value_bytes").cast("long").alias("value_bytes"))


def per_key(wal_entry: DataFrame, kvpair_put: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(totals, counts) of chunked_totals over both tables; keys are equal byte for byte over all stores."""
    rows = log_measures(wal_entry).unionByName(put_measures(kvpair_put))
    return chunked_totals(rows, ["table_name", "key_bytes"], MEASURES, chunk_rows)


def hot_keys(wal_entry: DataFrame, kvpair_put: DataFrame, share: float = 0.02, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys with at least ``share`` of all rows of their table (rows with a null key are in the total, never a case)."""
    totals, counts = per_key(wal_entry, kvpair_put, chunk_rows)
    tables = counts.groupBy("table_name").agg(F.sum("n").alias("total"))
    return totals.join(tables, "table_name").where(F.col("rows") >= share * F.col("total")).drop("total")
