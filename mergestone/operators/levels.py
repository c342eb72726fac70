"""Levels of runs, and reads through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergestone.operators.versions import resolve_by_tier
from mergestone.session import materialize, parallelism


def level_layout(meta: DataFrame) -> DataFrame:
    """Adds ``pos``, a run's place in its level from 1, and ``next_min``, the smallest key of the next run there.

    Level 0 is in order of arrival (the number); deeper levels by smallest key, arrival among equals. One row a run.
    """
    deep = F.col("level") > 0
    by = Window.partitionBy("store_id", "level").orderBy(F.when(deep, F.col("min_key")), "run")
    return meta.withColumn("pos", F.row_number().over(by)).withColumn("next_min", F.when(deep, F.lead("min_key").over(by)))


def manifest_levels(meta: DataFrame) -> DataFrame:
    """(store_id, level, runs, entries, bytes)."""
    return meta.groupBy("store_id", "level").agg(F.count(F.lit(1)).alias("runs"), F.sum("entry_count").alias("entries"), F.sum("data_bytes").alias("bytes"))


def visible_entries(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """The entries a level's lookup can reach, with ``tier`` (the level) and ``pos``.

    Level 0 looks at every run. A deeper level looks at one: the last whose smallest key is not above the key. An entry is
    reached if its run is that one, that is, if the next run of the level begins above the entry's key; so no range join is needed.
    """
    layout = level_layout(meta).select("store_id", "level", "run", "pos", "next_min")
    joined = entries.join(layout, ["store_id", "level", "run"])
    return joined.where(F.col("next_min").isNull() | (F.col("next_min") > F.col("key_bytes"))).withColumn("tier", F.col("level")).drop("next_min")


def tiered_get(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """What a read through the levels gives for every key, tombstones included: the first level that has it, the newest run in level 0."""
    return resolve_by_tier(visible_entries(entries, meta))


def engine_versions(log_entries: DataFrame, entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Memtable entries as tier -1 over the levels: what the engine reads through."""
    columns = ["store_id", "key_bytes", "value_bytes", "tombstone", "log_index", "tier", "pos"]
    memory = log_entries.withColumn("tier", F.lit(-1).cast("long")).withColumn("pos", F.lit(1))
    return memory.select(columns).unionByName(visible_entries(entries, meta).select(columns))


def route(wanted: DataFrame, meta: DataFrame, level: int, partitions: int | None = None) -> DataFrame:
    """For each wanted (store_id, key_bytes), once: ``run``, the one run of the level whose lookup would be opened, or null.

    The candidate is the run of the greatest smallest key not above the key, if the key is within its range. Runs and keys are
    range-partitioned together by store and key, and each partition carries the last run along: an as-of join in one
    pass, with no task larger than its range however many keys a store has. A partition begins with the last run of its store in
    those before it: at most one row for each partition and store that ends in it.
    """
    spark = wanted.sparkSession
    none = F.lit(None).cast("struct<pos:int,run:bigint,max_key:binary>")
    placed = level_layout(meta).where(F.col("level") == level).select("store_id", F.col("min_key").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("pos").cast("int").alias("pos"), "run", "max_key").alias("r"))
    keys = wanted.select("store_id", F.col("key_bytes").alias("at")).distinct().select("store_id", "at", F.lit(1).alias("kind"), none.alias("r"))
    order = ["store_id", "at", "kind", "r.pos"]
    n = partitions or parallelism(spark)
    laid = materialize(placed.unionByName(keys).repartitionByRange(n, "store_id", "at").withColumn("part", F.spark_partition_id()), "route")
    inside = Window.partitionBy("part", "store_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the greatest (key, place) of a store in each partition is the run it hands on
    ends = laid.where(F.col("kind") == 0).groupBy("store_id", "part").agg(F.max_by("r", F.struct("at", "r.pos")).alias("r"))
    parts = laid.select("store_id", "part").distinct().join(ends, ["store_id", "part"], "left")
    before = Window.partitionBy("store_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select("store_id", "part", F.last("r", ignorenulls=True).over(before).alias("handed"))
    seen = laid.withColumn("c", F.last("r", ignorenulls=True).over(inside)).where(F.col("kind") == 1).join(handed, ["store_id", "part"], "left")
    seen = seen.withColumn("c", F.coalesce("c", "handed"))
    return seen.select("store_id", F.col("at").alias("key_bytes"), F.when(F.col("c.max_key") >= F.col("at"), F.col("c.run")).alias("run"))
