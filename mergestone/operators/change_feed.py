"""Applying a stream of inserts, updates and deletes (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergestone.operators.log_records import valid_records
from mergestone.session import shared_path, shuffle_tasks, tasks_for
from mergestone.sources import files

#: Bytes of keys and values of a bucket: what one task holds in memory, in an embedded table, at a time.
BUCKET_BYTES = 32 << 20
#: The embedded table's memory; a bucket of a single larger row gets what that row needs.
DUCKDB_MEMORY = 512 << 20

STATE = "store_id int, key_bytes binary, value_bytes binary, deleted boolean, seq long"
_FIELDS = ("seq", "deleted", "value_bytes")

_CREATE = "CREATE OR REPLACE TABLE state (store_id INTEGER, key_bytes BLOB, value_bytes BLOB, deleted BOOLEAN, seq BIGINT, PRIMARY KEY (store_id, key_bytes))"
_LOAD = "INSERT INTO state SELECT store_id, key_bytes, stored_value_bytes, stored_deleted, stored_seq FROM bucket WHERE stored_seq IS NOT NULL"
_UPSERT = """
INSERT INTO state SELECT store_id, key_bytes, change_value_bytes, change_deleted, change_seq FROM bucket WHERE change_seq IS NOT NULL
ON CONFLICT (store_id, key_bytes) DO UPDATE
SET value_bytes = excluded.value_bytes, deleted = excluded.deleted, seq = excluded.seq
WHERE excluded.seq > state.seq
   OR (excluded.seq = state.seq AND (excluded.deleted > state.deleted
   OR (excluded.deleted = state.deleted AND excluded.value_bytes IS NOT NULL AND (state.value_bytes IS NULL OR excluded.value_bytes > state.value_bytes))))
"""
_EXPORT = "SELECT store_id, key_bytes, value_bytes, deleted, seq FROM state ORDER BY store_id, key_bytes"


def _pieces(batches: Iterator, most: int) -> Iterator[tuple[list, int]]:
    """Consecutive rows of at most ``most`` bytes, or one row, as (batches, bytes). Each row is a key of its own, so any cut will do."""
    import numpy as np
    import pyarrow.compute as pc

    held, size = [], 0
    for b in batches:
        lengths = np.zeros(b.num_rows, dtype=np.int64)
        for c in ("key_bytes", "stored_value_bytes", "change_value_bytes"):
            lengths += np.asarray(pc.fill_null(pc.binary_length(b.column(c)), 0), dtype=np.int64)
        ends, at = np.cumsum(lengths + 32), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, before + most - size, side="right"))
            if stop == at and held:
                yield held, size
                held, size = [], 0
                continue
            stop = max(stop, at + 1)
            held.append(b.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
    if held:
        yield held, size


def _upsert(bucket_bytes: int, memory: int):
    """Bucket by bucket: an embedded DuckDB table is loaded with what is stored, takes the changes by conditional upserts and is exported."""

    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(":memory:", config={"threads": 1})
        try:
            for held, size in _pieces(batches, bucket_bytes):
                con.execute(f"SET memory_limit = '{max(memory, 8 * size) >> 20}MB'")
                con.execute(_CREATE)
                con.register("bucket", pa.Table.from_batches(held))
                con.execute(_LOAD)
                con.execute(_UPSERT)
                con.unregister("bucket")
                yield from con.sql(_EXPORT).to_arrow_reader(10_000)
        finally:
            con.close()

    return run


def _usable(rows: DataFrame) -> DataFrame:
    there = F.col("store_id").isNotNull() & F.col("key_bytes").isNotNull() & F.col("seq").isNotNull()
    return rows.where(there).select("store_id", "key_bytes", F.struct("seq", F.coalesce("deleted", F.lit(False)).alias("deleted"), "value_bytes").alias("r"))


def apply_changes(changes: DataFrame, root: str, base: DataFrame | None = None, bucket_bytes: int = BUCKET_BYTES, memory: int = DUCKDB_MEMORY) -> DataFrame:
    """Applies changes (the columns of STATE; ``seq`` orders them) to the state published at ``root`` and publishes the new state.

    What is published there stays in force: a stored row changes only for a greater sequence number, so changes may come in any
    order, any number of times and over any number of calls, and a delete stays as a tombstone that older
    changes, also of later calls, can't undo. ``base`` are rows to begin from (or to take in) as if they were stored. Of
    changes with the same number a delete wins, then the greater value. Rows with a null store, key or number can't be
    applied and are left out; a null flag is no delete. An empty feed publishes the state as it was, at first an empty one.

    One shuffle by (store, key) brings what is stored of a key and its changes together, each combined before it, so a hot key sends
    one row for each input partition. A task cuts its keys into buckets of ``bucket_bytes`` and holds one of them,
    whatever the size of rows and partitions. All buckets become visible in one atomic step; should another caller have published in
    between, this one fails with ConcurrentUpdate and can be repeated. The state is written anew by each call, so batches
    should be large against it.
    """
    spark = changes.sparkSession
    now = files.published_as(spark, root)
    sides = [_usable(changes).withColumn("stored", F.lit(False))]
    for rows in (base, now and spark.read.schema(STATE).parquet(now["folder"])):
        if rows is not None:
            sides.append(_usable(rows).withColumn("stored", F.lit(True)))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    best = rows.groupBy("store_id", "key_bytes").agg(*[F.max(F.when(F.col("stored") == stored, F.col("r"))).alias(name) for stored, name in ((True, "s"), (False, "c"))])
    flat = best.select("store_id", "key_bytes", *[F.col(f"{side}.{f}").alias(f"{name}_{f}") for side, name in (("s", "stored"), ("c", "change")) for f in _FIELDS])
    with shuffle_tasks(spark, tasks_for(*sides)):
        files.publish(flat.mapInArrow(_upsert(bucket_bytes, memory), STATE), root, now["version"] if now else 0)
    return files.published(spark, root, STATE)


def stored_versions(sst_entry: DataFrame) -> DataFrame:
    """Versions of keys in stored runs, in the shape of changes."""
    return sst_entry.select("store_id", "key_bytes", "value_bytes", F.col("tombstone").alias("deleted"), F.col("log_index").alias("seq"))


def log_changes(wal_entry: DataFrame) -> DataFrame:
    """The log's valid records as changes. A record and what replaces it (the same index, a greater term) must be in one call."""
    return valid_records(wal_entry).select("store_id", "key_bytes", "value_bytes", (F.col("op_type") == 2).alias("deleted"), F.col("log_index").alias("seq"))


def current_state(wal_entry: DataFrame, sst_entry: DataFrame, root: str | None = None) -> DataFrame:
    """The published state of all keys, tombstones included: the stored versions, and the log's valid records applied to them."""
    return apply_changes(log_changes(wal_entry), root or shared_path(wal_entry.sparkSession, "state"), stored_versions(sst_entry))


def state_in_batches(wal_entry: DataFrame, sst_entry: DataFrame, root: str | None = None, batches: int = 3) -> DataFrame:
    """The same state from several calls: the log dealt into batches by index, the last first, the first of them applied twice, and
    the stored versions as changes in the middle. Whatever was applied before, late and repeated changes find it."""
    root = root or shared_path(wal_entry.sparkSession, "state")
    part = lambda i: log_changes(wal_entry.where(F.pmod("log_index", F.lit(batches)) == i))
    calls = [part(i) for i in reversed(range(batches))]
    calls.insert(1, stored_versions(sst_entry))
    for changes in [*calls, calls[0]]:
        state = apply_changes(changes, root)
    return state


def live(state: DataFrame, *columns: Column | str) -> DataFrame:
    """The keys that are there: tombstones are dropped last."""
    return state.where(~F.col("deleted")).select(*(columns or ("store_id", "key_bytes", "value_bytes", "seq")))
