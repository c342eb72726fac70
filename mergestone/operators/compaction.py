"""Compaction of level 0 into level 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.operators.levels import level_layout
from mergestone.operators.runs import run_meta
from mergestone.operators.versions import resolve_by_version


def level0_range(meta: DataFrame) -> DataFrame:
    """(store_id, min_key, max_key, runs) over all runs of level 0."""
    return meta.where(F.col("level") == 0).groupBy("store_id").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.count(F.lit(1)).alias("runs"))


def inputs(meta: DataFrame, trigger: int = 1) -> DataFrame:
    """(store_id, level, run, ord): all runs of level 0 and those of level 1 that overlap their range, in merge order.

    Stores with fewer than ``trigger`` runs in level 0 have no compaction. One range a store, so the join is by store alone.
    """
    span = level0_range(meta).where(F.col("runs") >= trigger).select("store_id", F.col("min_key").alias("low"), F.col("max_key").alias("high"))
    placed = level_layout(meta).where(F.col("level") <= 1).join(span, "store_id")
    hit = placed.where((F.col("level") == 0) | ((F.col("min_key") <= F.col("high")) & (F.col("max_key") >= F.col("low"))))
    return hit.select("store_id", "level", "run", (F.col("level") * (1 << 40) + F.col("pos")).alias("ord"))


def merge(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """The merged run of each store: a row a key, the greatest timestamp, among equals the first input; tombstones stay."""
    picked = entries.join(chosen, ["store_id", "level", "run"]).withColumn("source_level", F.col("level")).withColumn("source_run", F.col("run")).drop("level", "run")
    return resolve_by_version(picked.withColumnRenamed("ord", "run")).drop("run")


def manifest_after(meta: DataFrame, chosen: DataFrame, merged: DataFrame) -> DataFrame:
    """The catalog after the swap: without the inputs, and with one new run in level 1 for each store, numbered after the greatest."""
    kept = meta.join(chosen.select("store_id", "level", "run"), ["store_id", "level", "run"], "left_anti")
    number = meta.groupBy("store_id").agg((F.max("run") + 1).alias("run"))
    new = run_meta(merged.join(number, "store_id").withColumn("level", F.lit(1).cast("long")))
    return kept.unionByName(new.select(kept.columns))
