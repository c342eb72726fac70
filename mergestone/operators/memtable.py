"""The memtable: the latest version of each key of a part of the log, and when it is full."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergestone.functions.layout import memtable_bytes, wal_bytes
from mergestone.operators.versions import latest, live


def apply_log(records: DataFrame) -> DataFrame:
    """Log records (store_id, log_index, op_type, key_bytes, value_bytes) as the memtable's entries, tombstones kept.

    Put and delete are blind: the later record replaces the earlier, put after delete included.
    """
    tomb = F.col("op_type") == 2
    return latest(records.select("store_id", "key_bytes", "log_index", tomb.alias("tombstone"), F.when(~tomb, F.col("value_bytes")).alias("value_bytes")))


def get(entries: DataFrame, key: bytes, with_tombstones: bool = False) -> DataFrame:
    """The entry of a key in each store; the key filter goes down to the scan. Deleted keys only on request."""
    found = entries.where(F.col("key_bytes") == F.lit(key))
    return found if with_tombstones else live(found)


def entries_in_order(entries: DataFrame) -> DataFrame:
    """All entries, tombstones included, by key bytes: a distributed sort."""
    return entries.orderBy("store_id", "key_bytes")


def sizes(entries: DataFrame) -> DataFrame:
    """(store_id, n_keys, bytes): entries, tombstones included, and the estimate of their memory."""
    size = memtable_bytes(F.col("key_bytes"), F.col("value_bytes"))
    return entries.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(size).alias("bytes"))


def _fold(limit: int):
    """Walks a partition sorted by (store, index) from one memtable's end to the next: state is (store, epoch, its first index, its size).

    Within a memtable each record adds its bytes less those of the version it replaces there, so the end is the first place
    where the running sum reaches the limit; it is looked for in growing stretches.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        store, epoch, start, size = None, 0, 0, 0
        for b in batches:
            stores, index, sizes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("store_id", "log_index", "bytes"))
            replaces = ~np.asarray(pc.is_null(b.column("before_index")))
            before, back = (np.asarray(pc.fill_null(b.column(c), 0)) for c in ("before_index", "before_bytes"))
            out = np.empty(len(sizes), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(stores)) + 1).tolist(), len(stores)]
            for a, z in zip(cuts, cuts[1:]):
                if a < z and stores[a] != store:
                    store, epoch, start, size = stores[a], 1, index[a], 0
                step = 256
                while a < z:
                    if size >= limit:
                        epoch, start, size, step = epoch + 1, index[a], 0, 256
                    stop = min(z, a + step)
                    sums = size + np.cumsum(sizes[a:stop] - np.where(replaces[a:stop] & (before[a:stop] >= start), back[a:stop], 0))
                    full = np.flatnonzero(sums >= limit)
                    if len(full):
                        stop = a + int(full[0]) + 1  # the record that fills it belongs to it
                    out[a:stop] = epoch
                    size, a, step = int(sums[stop - a - 1]), stop, 2 * step
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out)], names=["store_id", "log_index", "bytes", "epoch"])

    return run


def _steps(limit: int):
    """Walks a partition sorted by (store, index) from one segment's end to the next, found in the running sums of a batch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        store, epoch, size = None, 0, 0
        for b in batches:
            stores, sizes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("store_id", "bytes"))
            ends, out = np.cumsum(sizes), np.empty(len(sizes), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(stores)) + 1).tolist(), len(stores)]
            for a, z in zip(cuts, cuts[1:]):
                if a < z and stores[a] != store:
                    store, epoch, size = stores[a], 1, 0
                while a < z:
                    if size >= limit:
                        epoch, size = epoch + 1, 0
                    before = int(ends[a] - sizes[a])
                    stop = min(z, int(np.searchsorted(ends, before + limit - size)) + 1)  # the record that fills the segment belongs to it
                    out[a:stop] = epoch
                    size += int(ends[stop - 1]) - before
                    a = stop
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "epoch"])

    return run


_EPOCHS = "store_id int, log_index long, bytes long, epoch long"


def flush_epochs(records: DataFrame, limit: int) -> DataFrame:
    """(store_id, log_index, bytes, epoch): which memtable of its store a record went into, from 1.

    A memtable is full once its live entries reach ``limit`` bytes, checked after each record, so the record that fills it
    belongs to it; a replaced version's bytes are given back if that version is in the same memtable. Each start
    depends on the one before, so a store is one sequential pass; it is streamed with constant memory, stores in parallel.
    """
    mine = Window.partitionBy("store_id", "key_bytes").orderBy("log_index")
    size = F.when(F.col("op_type") == 2, memtable_bytes(F.col("key_bytes"), F.lit(None).cast("binary"))).otherwise(memtable_bytes(F.col("key_bytes"), F.col("value_bytes")))
    sized = records.withColumn("bytes", size).select(
        "store_id", "log_index", "bytes", F.lag("log_index").over(mine).alias("before_index"), F.lag("bytes").over(mine).alias("before_bytes")
    )
    return sized.repartition("store_id").sortWithinPartitions("store_id", "log_index").mapInArrow(_fold(limit), _EPOCHS)


def rotation(records: DataFrame, limit: int, keep: Sequence[str] = ()) -> DataFrame:
    """(store_id, log_index, bytes, keep..., epoch): the log segment a record is written to, from 1; a segment is closed once it has ``limit`` bytes.

    Each segment's start depends on the end of the one before, so a store is one pass; it steps over segment ends only. The rows
    of a store stay together, in the order of their indexes.
    """
    sized = records.select("store_id", "log_index", wal_bytes(F.col("key_bytes"), F.col("value_bytes")).alias("bytes"), *keep)
    schema = T.StructType([*sized.schema.fields, T.StructField("epoch", T.LongType())])
    return sized.repartition("store_id").sortWithinPartitions("store_id", "log_index").mapInArrow(_steps(limit), schema)


def epoch_summary(epochs: DataFrame) -> DataFrame:
    """(store_id, epoch, records, first_index, last_index, bytes written)."""
    return epochs.groupBy("store_id", "epoch").agg(
        F.count(F.lit(1)).alias("records"), F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"), F.sum("bytes").alias("bytes")
    )
