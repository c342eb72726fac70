"""Sorted runs: statistics, sparse index, offsets, pruning and filters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.config import BLOOM_RATE, SPARSE_EVERY
from mergestone.functions.layout import run_bytes
from mergestone.operators.archive import file_level, file_number
from mergestone.operators.offsets import segmented_offsets
from mergestone.operators.versions import latest


def run_entries(sst_entry: DataFrame) -> DataFrame:
    """The entries of each run (store_id, run, level, key_bytes, value_bytes, tombstone, ts, log_index): a key once a run, its newest.

    A run holds unique keys; rows read twice and older versions in the same file are resolved by timestamp, then log index.
    """
    rows = sst_entry.select(
        "store_id", file_number(F.col("sst_path")).alias("run"), file_level(F.col("sst_path")).alias("level"), "key_bytes", "ts", "log_index",
        F.coalesce("tombstone", F.lit(False)).alias("tombstone"), "value_bytes",
    )
    return latest(rows, ("ts", "log_index"), ("store_id", "level", "run", "key_bytes"))


def run_meta(entries: DataFrame) -> DataFrame:
    """(store_id, level, run, entry_count, tombstones, min_key, max_key, data_bytes) of each run."""
    return entries.groupBy("store_id", "level", "run").agg(
        F.count(F.lit(1)).alias("entry_count"), F.sum(F.col("tombstone").cast("long")).alias("tombstones"), F.min("key_bytes").alias("min_key"), F.max("key_bytes").alias("max_key"),
        F.sum(run_bytes(F.col("key_bytes"), F.col("value_bytes"))).alias("data_bytes"),
    )


def entry_offsets(entries: DataFrame) -> DataFrame:
    """Adds ``nth`` (from 0) and ``offset``, the place of the entry's bytes in its run. A run may be spread over many tasks."""
    sized = entries.withColumn("nth", F.lit(1).cast("long")).withColumn("offset", run_bytes(F.col("key_bytes"), F.col("value_bytes")))
    placed = segmented_offsets(sized, ["store_id", "level", "run"], ["key_bytes"], ["nth", "offset"])
    return placed.select(*entries.columns, F.col("nth_before").alias("nth"), F.col("offset_before").alias("offset"))


def sparse_index(entries: DataFrame, every: int = SPARSE_EVERY) -> DataFrame:
    """Every 16th entry of each run, the first included, with its offset."""
    return entry_offsets(entries).where(F.col("nth") % every == 0)


def runs_for_key(meta: DataFrame, key: bytes) -> DataFrame:
    """The runs whose key range holds the key."""
    return meta.where((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def bloom_sizes(meta: DataFrame, rate: float = BLOOM_RATE) -> DataFrame:
    """Adds the textbook size of each run's filter: ``bloom_bits`` and ``bloom_hashes``."""
    bits = F.ceil(-F.col("entry_count") * F.log(F.lit(rate)) / F.pow(F.log(F.lit(2.0)), F.lit(2)))
    return meta.withColumn("bloom_bits", bits.cast("long")).withColumn("bloom_hashes", F.ceil(F.col("bloom_bits") / F.col("entry_count") * F.log(F.lit(2.0))).cast("int"))


#: Keys of one filter at most: a larger run has several, its keys dealt out by hash.
FILTER_KEYS = 1 << 20


def _probe(rate: float):
    """Streams entries sorted by filter; keeps the hashes of a filter's keys, then asks it for these and for as many absent ones."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from mergestone.sources.formats import KeyFilter

        names, kinds = ["store_id", "level", "run", "keys", "rejected", "false_positives"], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        current, present, absent, done = None, [], [], []

        def close() -> None:
            mine, other = np.concatenate(present), np.concatenate(absent)
            f = KeyFilter.sized(len(mine), rate)
            f.add_hashes(mine)
            done.append((*current[:3], len(mine), int((~f.may_contain_hashes(mine)).sum()), int(f.may_contain_hashes(other).sum())))
            present.clear()
            absent.clear()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
            done.clear()
            return batch

        for b in batches:
            ids = list(zip(*(b.column(c).to_pylist() for c in ("store_id", "level", "run", "part"))))
            keys = b.column("key_bytes").to_pylist()
            mine, other = KeyFilter.hash(keys), KeyFilter.hash(k + b"\xff" * 65 for k in keys)
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if ids[a] != current:
                    if present:
                        close()
                    current = ids[a]
                present.append(mine[a:z])
                absent.append(other[a:z])
            if done:
                yield out()
        if present:
            close()
        if done:
            yield out()

    return run


def bloom_probe(entries: DataFrame, rate: float = BLOOM_RATE, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """(store_id, level, run, keys, rejected, false_positives): present keys that the run's filters reject (always 0) and absent ones they let pass."""
    run = ["store_id", "level", "run"]
    counts = entries.groupBy(*run).agg(F.ceil(F.count(F.lit(1)) / filter_keys).alias("parts"))
    rows = entries.select(*run, "key_bytes").join(counts, run).select(*run, F.pmod(F.xxhash64("key_bytes"), F.col("parts")).alias("part"), "key_bytes")
    laid = rows.repartition(*run, "part").sortWithinPartitions(*run, "part")
    found = laid.mapInArrow(_probe(rate), "store_id int, level long, run long, keys long, rejected long, false_positives long")
    return found.groupBy(*run).agg(*[F.sum(c).alias(c) for c in ("keys", "rejected", "false_positives")])
