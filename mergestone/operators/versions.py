"""The core of the engine: versions of keys, and the two ways of resolving the one that counts.

By tier (point reads): the newest place that has the key wins, whatever the timestamps. By version (merges): the greatest
timestamp wins, and among equals the oldest run. Tombstones are versions like others; only an outermost read drops them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("store_id", "key_bytes")


def latest(versions: DataFrame, order: Sequence[str | Column] = ("log_index",), keys: Sequence[str] = KEY, keep: Sequence[str] | None = None) -> DataFrame:
    """The version of each key with the greatest ``order`` values; the other columns break ties, so the result is fixed.

    A hash-partitioned aggregation: versions are combined before the shuffle, so a key with a third of all versions
    sends one row for each input partition.
    """
    keep = keep or [c for c in versions.columns if c not in keys]
    named = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)]
    best = versions.groupBy(*keys).agg(F.max(F.struct(*named, *keep)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in keep])


def live(versions: DataFrame) -> DataFrame:
    """Without tombstones. A null flag is no tombstone. Only ever applied after a resolution."""
    return versions.where(~F.coalesce(F.col("tombstone"), F.lit(False)))


def resolve_by_tier(versions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One version of each key: of the smallest ``tier`` and, in it, the greatest ``pos``. Timestamps are ignored."""
    return latest(versions, (-F.col("tier"), F.col("pos")), keys)


def resolve_by_version(versions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One version of each key: of the greatest ``ts`` and, among equals, of the smallest ``run`` (the oldest)."""
    return latest(versions, (F.col("ts"), -F.col("run")), keys)


def as_of(versions: DataFrame, index: int, keys: Sequence[str] = KEY) -> DataFrame:
    """What was there after the record ``index``: the latest version up to it, tombstones dropped."""
    return live(latest(versions.where(F.col("log_index") <= index), keys=keys))


def key_range(versions: DataFrame, begin: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Keys in [begin, end); a missing bound is open. The comparison is on bytes and reaches the Parquet scan."""
    if begin is not None:
        versions = versions.where(F.col("key_bytes") >= F.lit(begin))
    if end is not None:
        versions = versions.where(F.col("key_bytes") < F.lit(end))
    return versions


def key_prefix(versions: DataFrame, prefix: bytes) -> DataFrame:
    """Keys that begin with prefix, as the range from it to its successor."""
    stem = prefix.rstrip(b"\xff")
    return key_range(versions, prefix, stem[:-1] + bytes([stem[-1] + 1]) if stem else None)


def multi_get(wanted: DataFrame, resolved: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Every wanted key once, with ``found`` and its value; tombstones and missing keys are not found.

    A left join on the key. ``resolved`` need have the wanted keys only, see wanted_only.
    """
    state = live(resolved).select(*keys, "value_bytes", F.lit(True).alias("found"))
    return wanted.select(*keys).distinct().join(state, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def wanted_only(versions: DataFrame, wanted: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The versions of wanted keys. Before a resolution it spares all others' shuffle and comparison; the keys are reduced to one row each."""
    return versions.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def read_amplification(versions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """For each key: its versions, and the runs that hold one."""
    by_run = versions.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"))
    return by_run.groupBy(*keys).agg(F.sum("n").alias("versions"), F.count(F.lit(1)).alias("runs"))
