"""Queries of the store's own operators over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.config import default_config
from mergestone.engine import Engine
from mergestone.functions.layout import pack_be, run_name, unpack_be, wal_payload
from mergestone.operators import compaction, levels, log, memtable, runs, versions
from mergestone.operators.log_records import valid_records
from mergestone.plans.problems import _VALID, _read
from mergestone.session import materialize, shared_path

#: Keys that the point reads ask for.
HOT, FLAGS, PREFIX = b"HB", b"cfg/feature-flags", b"tmp/job-"
#: Limits small enough to be reached on every size of the data.
MEMTABLE_LIMIT, SEGMENT_LIMIT = 4_096, 4_096


def _store() -> Column:
    return F.col("store_id").cast("long").alias("store_id")


def _hex(c: str, name: str) -> Column:
    return F.lower(F.hex(c)).alias(name)


def _key() -> Column:
    return _hex("key_bytes", "key_hex")


def _value() -> Column:
    return _hex("value_bytes", "value_hex")


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return valid_records(_read(spark, sf, "wal_entry"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_entries(_read(spark, sf, "sst_entry"))


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_meta(_entries(spark, sf))


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    """The active memtable: the log above the truncation mark."""
    return memtable.apply_log(log.after_mark(_valid(spark, sf), _read(spark, sf, "wal_meta")))


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The entries of all runs and the runs' statistics, from one pass over the versions."""
    entries = materialize(_entries(spark, sf), "run-entries")
    return entries, runs.run_meta(entries)


def _engine(spark: SparkSession, sf: str, few: bool = False) -> DataFrame:
    """What the engine resolves to. Where a condition leaves ``few`` keys, it goes down to the scan; else the runs are read once."""
    entries, meta = (_entries(spark, sf), _meta(spark, sf)) if few else _tree(spark, sf)
    return versions.resolve_by_tier(levels.engine_versions(_memory(spark, sf), entries, meta))


# ------------------------------------------------------------------------------------ memtable and reads
def kv_live_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(memtable.apply_log(_valid(spark, sf))).select(_store(), _key(), _value(), "log_index")


def kv_memtable_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(_memory(spark, sf)).select(_store(), _key(), _value())


def memtable_entries_all(spark: SparkSession, sf: str) -> DataFrame:
    return memtable.entries_in_order(memtable.apply_log(_valid(spark, sf))).select(_store(), _key(), _value(), "tombstone", "log_index")


def memtable_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return memtable.sizes(memtable.apply_log(_valid(spark, sf))).select(_store(), "n_keys", F.col("bytes").alias("n_bytes"))


def kv_point_get(spark: SparkSession, sf: str) -> DataFrame:
    return memtable.get(_engine(spark, sf, few=True), HOT).select(_store(), _key(), _value())


def kv_point_get_t(spark: SparkSession, sf: str) -> DataFrame:
    return memtable.get(memtable.apply_log(_valid(spark, sf)), FLAGS, with_tombstones=True).select(_store(), _key(), _value(), "tombstone")


def kv_multi_get(spark: SparkSession, sf: str) -> DataFrame:
    wanted, through = _read(spark, sf, "kvpair_primary"), levels.engine_versions(_memory(spark, sf), *_tree(spark, sf))
    return versions.multi_get(wanted, versions.resolve_by_tier(versions.wanted_only(through, wanted))).select(_store(), _key(), _value(), "found")


# ------------------------------------------------------------------------------------ log
def wal_segments(spark: SparkSession, sf: str) -> DataFrame:
    return log.segments(_read(spark, sf, "wal_entry")).select(_store(), F.col("segment").cast("long").alias("segment"), F.col("records").alias("n_records"), "first_index", "last_index", F.col("bytes").alias("n_bytes"))


def wal_next_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return log.next_numbers(_read(spark, sf, "wal_entry")).select(_store(), "next_index", F.col("next_segment").cast("long").alias("next_segment"))


def wal_recover_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return log.after_mark(_valid(spark, sf), _read(spark, sf, "wal_meta")).select(_store(), "log_index", F.col("op_type").cast("int").alias("op_type"), _key(), _value())


def wal_stop_at_damage(spark: SparkSession, sf: str) -> DataFrame:
    kept = log.stop_at_damage(_read(spark, sf, "wal_entry"))
    return kept.groupBy("store_id", "segment").agg(F.count(F.lit(1)).alias("n_records"), F.max("log_index").alias("last_index")).select(_store(), F.col("segment").cast("long").alias("segment"), "n_records", "last_index")


def wal_crc32(spark: SparkSession, sf: str) -> DataFrame:
    return log.with_checksum(_valid(spark, sf)).select(_store(), "log_index", "crc32", F.octet_length("record").cast("long").alias("n_bytes"))


def wal_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Each valid record as the bytes of its payload."""
    payload = wal_payload(*(F.col(c) for c in ("term", "log_index", "op_type", "key_bytes", "value_bytes")))
    return _valid(spark, sf).select(_store(), "log_index", F.lower(F.hex(payload)).alias("payload_hex"))


def wal_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return memtable.epoch_summary(memtable.rotation(_valid(spark, sf), SEGMENT_LIMIT)).select(_store(), F.col("epoch").alias("segment_no"), F.col("records").alias("n_records"), "first_index", "last_index", F.col("bytes").alias("n_bytes"))


def flush_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return memtable.epoch_summary(memtable.flush_epochs(_valid(spark, sf), MEMTABLE_LIMIT)).select(_store(), "epoch", F.col("records").alias("n_records"), "first_index", "last_index")


def wal_file_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The valid records written as binary segments, a folder a store, and read back."""
    from mergestone.sources.readers import register

    register(spark)
    folder = shared_path(spark, "wal-files")
    rows = memtable.rotation(_valid(spark, sf), 64 * SEGMENT_LIMIT, ["term", "op_type", "key_bytes", "value_bytes"])
    rows = rows.select(F.format_string("store-%04d", "store_id").alias("folder"), F.col("epoch").cast("int").alias("segment"), "term", "log_index", "op_type", "key_bytes", "value_bytes")
    rows.write.format("wal").mode("append").save(folder)
    back = spark.read.format("wal").load(folder)
    return back.select(F.regexp_extract("path", r"store-(\d+)/", 1).cast("long").alias("store_id"), "term", "log_index", F.col("op_type").cast("int").alias("op_type"), _key(), F.coalesce(_value(), F.lit("")).alias("value_hex"))


# ------------------------------------------------------------------------------------ runs
def _run_id() -> list:
    return [_store(), F.col("level").alias("sst_level"), F.col("run").alias("sst_id")]


def sst_meta(spark: SparkSession, sf: str) -> DataFrame:
    return _meta(spark, sf).select(*_run_id(), "entry_count", "tombstones", _hex("min_key", "min_hex"), _hex("max_key", "max_hex"), "data_bytes")


def sst_sparse_index(spark: SparkSession, sf: str) -> DataFrame:
    return runs.sparse_index(_entries(spark, sf)).select(*_run_id(), _key(), F.col("offset").alias("at"))


def sst_entry_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return runs.entry_offsets(_entries(spark, sf)).select(*_run_id(), _key(), F.col("nth").cast("long").alias("nth"), F.col("offset").alias("at"))


def sst_range_prune(spark: SparkSession, sf: str) -> DataFrame:
    return runs.runs_for_key(_meta(spark, sf), HOT).select(*_run_id())


def bloom_sizing(spark: SparkSession, sf: str) -> DataFrame:
    return runs.bloom_sizes(_meta(spark, sf)).select(*_run_id(), "bloom_bits", F.col("bloom_hashes").cast("long").alias("bloom_hashes"))


def bloom_no_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return runs.bloom_probe(_entries(spark, sf)).groupBy("level").agg(F.sum("keys").alias("n_keys"), F.sum("rejected").alias("rejected"), F.sum("false_positives").alias("false_positives"))


def _run_files(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of all runs written as binary run files, to be read."""
    from mergestone.sources.readers import register

    register(spark)
    folder = shared_path(spark, "sst-files")
    rows = _entries(spark, sf).select(run_name(F.col("level"), F.col("run")).alias("file"), "key_bytes", "value_bytes", "tombstone", "ts")
    rows.repartition("file").sortWithinPartitions("file", "key_bytes").write.format("sst").mode("append").save(folder)
    return spark.read.format("sst").load(folder)


def _from_runs(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_extract("path", r"(\d+)\.sst$", 1).cast("long").alias("sst_id"), _key(), F.coalesce(_value(), F.lit("")).alias("value_hex"), "tombstone", "ts")


def bloom_keys_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The keys each run's filter was given, and how many of them it doesn't know: none."""
    return runs.bloom_probe(_entries(spark, sf)).select(*_run_id(), F.col("keys").alias("n_keys"), "rejected")


def sst_file_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return _from_runs(_run_files(spark, sf))


def sst_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Keys looked up in the binary runs: range, filter, sparse index and a block of each."""
    return _from_runs(_run_files(spark, sf).where(F.col("key_bytes").isin(HOT, FLAGS)))


def sst_scan_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range of keys in the binary runs, from the block of its first key on."""
    return _from_runs(_run_files(spark, sf).where((F.col("key_bytes") >= F.lit(b"cfg/")) & (F.col("key_bytes") < F.lit(b"q"))))


# ------------------------------------------------------------------------------------ levels
def l0_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    entries, meta = _tree(spark, sf)
    zero = levels.tiered_get(entries.where("level = 0"), meta.where("level = 0"))
    return zero.select(_store(), _key(), F.col("run").alias("sst_id"), "tombstone")


def l1_route(spark: SparkSession, sf: str) -> DataFrame:
    return levels.route(_read(spark, sf, "kvpair_primary"), _meta(spark, sf), 1).select(_store(), _key(), F.col("run").alias("sst_id"))


def lsm_tiered_get(spark: SparkSession, sf: str) -> DataFrame:
    return levels.tiered_get(*_tree(spark, sf)).select(_store(), _key(), F.col("level").alias("sst_level"), F.col("run").alias("sst_id"), "tombstone")


def lsm_visible(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(_engine(spark, sf)).select(_store(), _key(), _value())


def manifest_levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels.manifest_levels(_meta(spark, sf)).select(_store(), F.col("level").alias("sst_level"), F.col("runs").alias("n_runs"), F.col("entries").alias("n_entries"), F.col("bytes").alias("n_bytes"))


def read_amplification(spark: SparkSession, sf: str) -> DataFrame:
    return versions.read_amplification(_entries(spark, sf)).select(_store(), _key(), F.col("versions").alias("n_versions"), F.col("runs").alias("n_runs"))


# ------------------------------------------------------------------------------------ merge and compaction
def merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return versions.resolve_by_version(_entries(spark, sf).where("level = 0")).select(_store(), _key(), _value(), "tombstone", F.col("run").alias("sst_id"))


def merge_tie_break(spark: SparkSession, sf: str) -> DataFrame:
    """Times made equal on purpose: the oldest run must win among equals."""
    tied = _entries(spark, sf).withColumn("ts", F.floor(F.col("log_index") / 2000))
    return versions.resolve_by_version(tied).select(_store(), _key(), F.col("ts").alias("coarse_ts"), F.col("run").alias("sst_id"))


def compaction_key_range(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.level0_range(_meta(spark, sf)).select(_store(), _hex("min_key", "min_hex"), _hex("max_key", "max_hex"), F.col("runs").alias("n_runs"))


def compaction_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.inputs(_meta(spark, sf)).select(*_run_id())


def compaction_output(spark: SparkSession, sf: str) -> DataFrame:
    entries, meta = _tree(spark, sf)
    merged = compaction.merge(entries, compaction.inputs(meta))
    return merged.select(_store(), _key(), _value(), "tombstone", "ts")


def manifest_after_compaction(spark: SparkSession, sf: str) -> DataFrame:
    entries, meta = _tree(spark, sf)
    chosen = compaction.inputs(meta)
    after = compaction.manifest_after(meta, chosen, compaction.merge(entries, chosen))
    return after.select(*_run_id(), "entry_count", _hex("min_key", "min_hex"), _hex("max_key", "max_hex"))


# ------------------------------------------------------------------------------------ the engine itself
def _operations(spark: SparkSession, sf: str) -> DataFrame:
    """The valid records as operations on one key space: the store's number in four bytes, then the key."""
    return _valid(spark, sf).select("log_index", _composed(), "value_bytes", (F.col("op_type") == 2).alias("delete"))


def _composed() -> Column:
    return F.concat(pack_be(F.col("store_id"), 4), F.col("key_bytes")).alias("key_bytes")


def _parted(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select(unpack_be(F.col("key_bytes"), 0, 4).alias("store_id"), F.lower(F.hex(F.expr("substring(key_bytes, 5)"))).alias("key_hex"), _value(), *more)


def _filled_engine(spark: SparkSession, sf: str) -> Engine:
    """An engine that took the log in five batches, flushed four of them, compacted their runs, and was opened again before the last."""
    ops, root = materialize(_operations(spark, sf), "operations"), shared_path(spark, "engine")
    ends = ops.agg(F.min("log_index").alias("low"), F.max("log_index").alias("high")).first()
    cuts = [] if ends["low"] is None else [ends["low"] + (ends["high"] - ends["low"]) * k // 5 for k in range(1, 5)]
    bounds = [None, *cuts, None]
    config = default_config(root)
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = ops if low is None else ops.where(F.col("log_index") > low)
        part = part if high is None else part.where(F.col("log_index") <= high)
        engine = Engine(spark, config if i == len(cuts) else replace(config, memtable_bytes=1))
        engine.apply(part, "log_index")
    return engine


def engine_store(spark: SparkSession, sf: str) -> DataFrame:
    """All live keys, read through memtable and levels."""
    return _parted(_filled_engine(spark, sf).full_snapshot())


def engine_multi_get(spark: SparkSession, sf: str) -> DataFrame:
    wanted = _read(spark, sf, "kvpair_primary").select(_composed())
    return _parted(_filled_engine(spark, sf).multi_get(wanted), "found")


def engine_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog's newest document as a table: four flushed runs have become one of level 1."""
    from mergestone.sources.manifest import RUNS

    document = _filled_engine(spark, sf).manifest.document
    doc = spark.read.schema(RUNS).json(document.path())
    run = doc.select("nextSSTableId", F.explode("sstables").alias("r"))
    return run.select(F.col("nextSSTableId").alias("next_id"), F.col("r.level").cast("long").alias("sst_level"), "r.entry_count", *[F.lower(f"r.{c}").alias(f"{c[:3]}_hex") for c in ("min_key", "max_key")])


def engine_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The live keys of the memtable alone, all records being in it."""
    engine = Engine(spark, default_config(shared_path(spark, "engine")))
    engine.apply(_operations(spark, sf), "log_index")
    return _parted(engine.snapshot())


def engine_log_files(spark: SparkSession, sf: str) -> DataFrame:
    """An engine's log, with the indexes it gave, written as binary segments and read back."""
    engine, folder = Engine(spark, replace(default_config(shared_path(spark, "engine")), wal_segment_bytes=64 * SEGMENT_LIMIT)), shared_path(spark, "engine-log")
    engine.apply(_operations(spark, sf), "log_index")
    engine.export_log(folder)
    back = spark.read.format("wal").load(folder)
    return _parted(back.withColumn("value_bytes", F.coalesce("value_bytes", F.lit(b""))), "log_index", F.col("op_type").cast("int").alias("op_type"))


# ------------------------------------------------------------------------------------ extensions
def ext_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(versions.key_range(_engine(spark, sf, few=True), b"cfg/", b"q")).select(_store(), _key(), _value())


def ext_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    return versions.live(versions.key_prefix(_engine(spark, sf, few=True), PREFIX)).select(_store(), _key(), _value())


def ext_as_of_index(spark: SparkSession, sf: str) -> DataFrame:
    ops = _valid(spark, sf).select("store_id", "key_bytes", "log_index", (F.col("op_type") == 2).alias("tombstone"), "value_bytes")
    return versions.as_of(ops, 2_500).select(_store(), _key(), "log_index")


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The log read as a stream into keyed state; the same rows as a batch resolution of undamaged records by index."""
    from mergestone.streaming.log_stream import latest_by_stream

    return latest_by_stream(spark, f"{sf}/wal_entry.parquet").select(_store(), _key(), "log_index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kv_live_snapshot, kv_memtable_snapshot, memtable_entries_all, memtable_sizes, kv_point_get, kv_point_get_t, kv_multi_get,
        wal_segments, wal_next_numbers, wal_recover_truncated, wal_stop_at_damage, wal_crc32, wal_payloads, wal_rotation, flush_epochs, wal_file_round_trip,
        sst_meta, sst_sparse_index, sst_entry_offsets, sst_range_prune, bloom_sizing, bloom_no_false_negatives, bloom_keys_kept, sst_file_round_trip, sst_lookup, sst_scan_range,
        l0_newest_first, l1_route, lsm_tiered_get, lsm_visible, manifest_levels, read_amplification,
        merge_dedup, merge_tie_break, compaction_key_range, compaction_inputs, compaction_output, manifest_after_compaction,
        engine_store, engine_multi_get, engine_manifest, engine_snapshot, engine_log_files,
        ext_range_scan, ext_prefix_scan, ext_as_of_index, stream_latest,
    )
}

# ------------------------------------------------------------------------------------ SQL
_LOG = f"""{_VALID},
latest AS (SELECT * FROM (SELECT store_id, key_bytes, log_index, op_type = 2 AS tombstone, CASE WHEN op_type = 1 THEN value_bytes END AS value_bytes,
           row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY log_index DESC) AS n FROM valid) WHERE n = 1),
marks AS (SELECT * FROM (SELECT store_id, truncated_before, row_number() OVER (PARTITION BY store_id ORDER BY save_seq DESC, truncated_before DESC) AS n
          FROM wal_meta WHERE committed AND truncated_before IS NOT NULL) WHERE n = 1),
above AS (SELECT v.* FROM valid v LEFT JOIN marks m ON v.store_id = m.store_id WHERE m.store_id IS NULL OR v.log_index > m.truncated_before),
memory AS (SELECT * FROM (SELECT store_id, key_bytes, log_index, op_type = 2 AS tombstone, CASE WHEN op_type = 1 THEN value_bytes END AS value_bytes,
           row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY log_index DESC) AS n FROM above) WHERE n = 1)"""
_RUNS = """
entries AS (SELECT * FROM (
  SELECT store_id, CAST(regexp_extract(sst_path, 'L([0-9]+)/', 1) AS BIGINT) AS lvl, CAST(regexp_extract(sst_path, '([0-9]+)\\.sst$', 1) AS BIGINT) AS run,
         key_bytes, value_bytes, coalesce(tombstone, false) AS tombstone, ts, log_index, coalesce(octet_length(key_bytes), 0) + coalesce(octet_length(value_bytes), 0) + 15 AS sz,
         row_number() OVER (PARTITION BY sst_path, store_id, key_bytes ORDER BY ts DESC, log_index DESC, tombstone DESC, value_bytes DESC NULLS LAST) AS n FROM sst_entry) WHERE n = 1),
meta AS (SELECT store_id, lvl, run, count(*) AS entry_count, count(*) FILTER (tombstone) AS tombstones, min(key_bytes) AS min_key, max(key_bytes) AS max_key, CAST(sum(sz) AS BIGINT) AS data_bytes
         FROM entries GROUP BY store_id, lvl, run),
layout AS (SELECT *, row_number() OVER w AS pos, CASE WHEN lvl > 0 THEN lead(min_key) OVER w END AS next_min FROM meta
           WINDOW w AS (PARTITION BY store_id, lvl ORDER BY CASE WHEN lvl > 0 THEN min_key END, run)),
seen AS (SELECT e.*, l.pos FROM entries e JOIN layout l ON e.store_id = l.store_id AND e.lvl = l.lvl AND e.run = l.run WHERE l.next_min IS NULL OR l.next_min > e.key_bytes),
tiered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY lvl, pos DESC) AS r FROM seen) WHERE r = 1)"""
_ENGINE = f"""WITH {_LOG}, {_RUNS},
through AS (SELECT store_id, key_bytes, value_bytes, tombstone, -1 AS lvl, 1 AS pos FROM memory UNION ALL SELECT store_id, key_bytes, value_bytes, tombstone, lvl, pos FROM seen),
engine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY lvl, pos DESC) AS r FROM through) WHERE r = 1)"""
_S, _K, _V = "CAST(store_id AS BIGINT) AS store_id", "lower(hex(key_bytes)) AS key_hex", "lower(hex(value_bytes)) AS value_hex"
_R = f"{_S}, lvl AS sst_level, run AS sst_id"
_CHOSEN = f"""WITH {_RUNS},
span AS (SELECT store_id, min(min_key) AS low, max(max_key) AS high FROM meta WHERE lvl = 0 GROUP BY store_id),
chosen AS (SELECT l.* FROM layout l JOIN span s ON l.store_id = s.store_id WHERE lvl = 0 OR (lvl = 1 AND min_key <= high AND max_key >= low)),
merged AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.store_id, e.key_bytes ORDER BY e.ts DESC, e.lvl, c.pos) AS r
           FROM entries e JOIN chosen c ON e.store_id = c.store_id AND e.lvl = c.lvl AND e.run = c.run) WHERE r = 1)"""


def _folded(start: str, grow: str) -> str:
    """A reset accumulator as a recursion over the records of all stores at once."""
    return f"""
ops AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY log_index) AS rn,
               lag(log_index) OVER (PARTITION BY store_id, key_bytes ORDER BY log_index) AS before_index, lag(sz) OVER (PARTITION BY store_id, key_bytes ORDER BY log_index) AS before_sz
        FROM (SELECT store_id, log_index, key_bytes, {start} AS sz FROM valid)),
f AS (SELECT store_id, rn, log_index, sz, CAST(1 AS BIGINT) AS epoch, log_index AS start_index, CAST(sz AS BIGINT) AS held FROM ops WHERE rn = 1
      UNION ALL
      SELECT o.store_id, o.rn, o.log_index, o.sz, CASE WHEN f.held >= 4096 THEN f.epoch + 1 ELSE f.epoch END, CASE WHEN f.held >= 4096 THEN o.log_index ELSE f.start_index END,
             CASE WHEN f.held >= 4096 THEN o.sz ELSE f.held + o.sz{grow} END
      FROM f JOIN ops o ON o.store_id = f.store_id AND o.rn = f.rn + 1)"""


ORACLE_SQL: dict[str, str] = {
    "kv_live_snapshot": f"WITH {_LOG} SELECT {_S}, {_K}, {_V}, log_index FROM latest WHERE NOT tombstone",
    "kv_memtable_snapshot": f"WITH {_LOG} SELECT {_S}, {_K}, {_V} FROM memory WHERE NOT tombstone",
    "memtable_entries_all": f"WITH {_LOG} SELECT {_S}, {_K}, {_V}, tombstone, log_index FROM latest",
    "memtable_sizes": f"WITH {_LOG} SELECT {_S}, count(*) AS n_keys, CAST(sum(octet_length(key_bytes) + coalesce(octet_length(value_bytes), 0) + 41) AS BIGINT) AS n_bytes FROM latest GROUP BY store_id",
    "kv_point_get": f"{_ENGINE} SELECT {_S}, {_K}, {_V} FROM engine WHERE key_bytes = 'HB'::BLOB AND NOT tombstone",
    "kv_point_get_t": f"WITH {_LOG} SELECT {_S}, {_K}, {_V}, tombstone FROM latest WHERE key_bytes = 'cfg/feature-flags'::BLOB",
    "kv_multi_get": f"""{_ENGINE} SELECT CAST(w.store_id AS BIGINT) AS store_id, lower(hex(w.key_bytes)) AS key_hex, lower(hex(e.value_bytes)) AS value_hex, e.store_id IS NOT NULL AS found
        FROM (SELECT DISTINCT store_id, key_bytes FROM kvpair_primary) w LEFT JOIN (SELECT * FROM engine WHERE NOT tombstone) e ON w.store_id = e.store_id AND w.key_bytes = e.key_bytes""",
    "wal_segments": f"""SELECT {_S}, CAST(segment AS BIGINT) AS segment, count(*) AS n_records, min(log_index) AS first_index, max(log_index) AS last_index,
        CAST(sum(27 + coalesce(octet_length(key_bytes), 0) + coalesce(octet_length(value_bytes), 0)) AS BIGINT) AS n_bytes FROM wal_entry GROUP BY store_id, segment""",
    "wal_next_numbers": f"SELECT {_S}, max(log_index) + 1 AS next_index, CAST(max(segment) + 1 AS BIGINT) AS next_segment FROM wal_entry GROUP BY store_id",
    "wal_recover_truncated": f"WITH {_LOG} SELECT {_S}, log_index, CAST(op_type AS INTEGER) AS op_type, {_K}, {_V} FROM above",
    "wal_stop_at_damage": f"""WITH bad AS (SELECT store_id, segment, min(log_index) AS first_bad FROM wal_entry WHERE op_type IS NULL OR op_type NOT IN (1, 2) OR key_bytes IS NULL GROUP BY store_id, segment)
        SELECT CAST(w.store_id AS BIGINT) AS store_id, CAST(w.segment AS BIGINT) AS segment, count(*) AS n_records, max(log_index) AS last_index
        FROM wal_entry w LEFT JOIN bad b ON w.store_id = b.store_id AND w.segment = b.segment WHERE first_bad IS NULL OR log_index < first_bad GROUP BY w.store_id, w.segment""",
    "wal_rotation": f"""WITH RECURSIVE {_VALID}, {_folded("27 + octet_length(key_bytes) + coalesce(octet_length(value_bytes), 0)", "")}
        SELECT {_S}, epoch AS segment_no, count(*) AS n_records, min(log_index) AS first_index, max(log_index) AS last_index, CAST(sum(sz) AS BIGINT) AS n_bytes FROM f GROUP BY store_id, epoch""",
    "flush_epochs": f"""WITH RECURSIVE {_VALID}, {_folded("41 + octet_length(key_bytes) + CASE WHEN op_type = 1 THEN coalesce(octet_length(value_bytes), 0) ELSE 0 END", " - CASE WHEN o.before_index >= f.start_index THEN o.before_sz ELSE 0 END")}
        SELECT {_S}, epoch, count(*) AS n_records, min(log_index) AS first_index, max(log_index) AS last_index FROM f GROUP BY store_id, epoch""",
    "wal_file_round_trip": """WITH valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, log_index ORDER BY coalesce(term, 0) DESC, op_type DESC) AS n
          FROM wal_entry WHERE op_type IN (1, 2) AND key_bytes IS NOT NULL) WHERE n = 1)
        SELECT CAST(store_id AS BIGINT) AS store_id, coalesce(term, 0) AS term, log_index, CAST(op_type AS INTEGER) AS op_type, lower(hex(key_bytes)) AS key_hex, coalesce(lower(hex(value_bytes)), '') AS value_hex FROM valid""",
    "sst_meta": f"WITH {_RUNS} SELECT {_R}, entry_count, tombstones, lower(hex(min_key)) AS min_hex, lower(hex(max_key)) AS max_hex, data_bytes FROM meta",
    "sst_sparse_index": f"""WITH {_RUNS}, o AS (SELECT *, row_number() OVER w - 1 AS nth, sum(sz) OVER w - sz AS place FROM entries WINDOW w AS (PARTITION BY store_id, lvl, run ORDER BY key_bytes ROWS UNBOUNDED PRECEDING))
        SELECT {_R}, {_K}, CAST(place AS BIGINT) AS "at" FROM o WHERE nth % 16 = 0""",
    "sst_entry_offsets": f"""WITH {_RUNS} SELECT {_R}, {_K}, row_number() OVER w - 1 AS nth, CAST(sum(sz) OVER w - sz AS BIGINT) AS "at" FROM entries WINDOW w AS (PARTITION BY store_id, lvl, run ORDER BY key_bytes ROWS UNBOUNDED PRECEDING)""",
    "sst_range_prune": f"WITH {_RUNS} SELECT {_R} FROM meta WHERE min_key <= 'HB'::BLOB AND max_key >= 'HB'::BLOB",
    "bloom_sizing": f"""WITH {_RUNS}, b AS (SELECT *, CAST(ceil(-entry_count * ln(0.01) / pow(ln(2.0), 2)) AS BIGINT) AS bloom_bits FROM meta)
        SELECT {_R}, bloom_bits, CAST(ceil(bloom_bits / entry_count * ln(2.0)) AS BIGINT) AS bloom_hashes FROM b""",
    "sst_file_round_trip": f"WITH {_RUNS} SELECT run AS sst_id, {_K}, coalesce(lower(hex(value_bytes)), '') AS value_hex, tombstone, ts FROM entries",
    "l0_newest_first": f"WITH {_RUNS} SELECT {_S}, {_K}, run AS sst_id, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY run DESC) AS r FROM entries WHERE lvl = 0) WHERE r = 1",
    "l1_route": f"""WITH {_RUNS}, w AS (SELECT DISTINCT store_id, key_bytes FROM kvpair_primary),
        hit AS (SELECT w.store_id, w.key_bytes, l.run, l.max_key, row_number() OVER (PARTITION BY w.store_id, w.key_bytes ORDER BY l.pos DESC) AS r
                FROM w JOIN layout l ON l.store_id = w.store_id AND l.lvl = 1 AND l.min_key <= w.key_bytes)
        SELECT CAST(w.store_id AS BIGINT) AS store_id, lower(hex(w.key_bytes)) AS key_hex, CASE WHEN h.max_key >= w.key_bytes THEN h.run END AS sst_id
        FROM w LEFT JOIN hit h ON w.store_id = h.store_id AND w.key_bytes = h.key_bytes AND h.r = 1""",
    "lsm_tiered_get": f"WITH {_RUNS} SELECT {_S}, {_K}, lvl AS sst_level, run AS sst_id, tombstone FROM tiered",
    "lsm_visible": f"{_ENGINE} SELECT {_S}, {_K}, {_V} FROM engine WHERE NOT tombstone",
    "manifest_levels": f"WITH {_RUNS} SELECT {_S}, lvl AS sst_level, count(*) AS n_runs, CAST(sum(entry_count) AS BIGINT) AS n_entries, CAST(sum(data_bytes) AS BIGINT) AS n_bytes FROM meta GROUP BY store_id, lvl",
    "read_amplification": f"WITH {_RUNS} SELECT {_S}, {_K}, count(*) AS n_versions, count(DISTINCT run) AS n_runs FROM entries GROUP BY store_id, key_bytes",
    "merge_dedup": f"WITH {_RUNS} SELECT {_S}, {_K}, {_V}, tombstone, run AS sst_id FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY ts DESC, run) AS r FROM entries WHERE lvl = 0) WHERE r = 1",
    "merge_tie_break": f"WITH {_RUNS} SELECT {_S}, {_K}, log_index // 2000 AS coarse_ts, run AS sst_id FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY log_index // 2000 DESC, run) AS r FROM entries) WHERE r = 1",
    "compaction_key_range": f"WITH {_RUNS} SELECT {_S}, lower(hex(min(min_key))) AS min_hex, lower(hex(max(max_key))) AS max_hex, count(*) AS n_runs FROM meta WHERE lvl = 0 GROUP BY store_id",
    "compaction_inputs": f"{_CHOSEN} SELECT {_R} FROM chosen",
    "compaction_output": f"{_CHOSEN} SELECT {_S}, {_K}, {_V}, tombstone, ts FROM merged",
    "manifest_after_compaction": f"""{_CHOSEN}, number AS (SELECT store_id, max(run) + 1 AS run FROM meta GROUP BY store_id)
        SELECT {_R}, entry_count, lower(hex(min_key)) AS min_hex, lower(hex(max_key)) AS max_hex FROM meta m WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.store_id = m.store_id AND c.lvl = m.lvl AND c.run = m.run)
        UNION ALL SELECT CAST(g.store_id AS BIGINT), 1, n.run, count(*), lower(hex(min(key_bytes))), lower(hex(max(key_bytes))) FROM merged g JOIN number n ON g.store_id = n.store_id GROUP BY g.store_id, n.run""",
    "ext_range_scan": f"{_ENGINE} SELECT {_S}, {_K}, {_V} FROM engine WHERE NOT tombstone AND key_bytes >= 'cfg/'::BLOB AND key_bytes < 'q'::BLOB",
    "ext_prefix_scan": f"{_ENGINE} SELECT {_S}, {_K}, {_V} FROM engine WHERE NOT tombstone AND starts_with(lower(hex(key_bytes)), '746d702f6a6f622d')",
    "ext_as_of_index": f"""WITH {_VALID} SELECT {_S}, {_K}, log_index FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY log_index DESC) AS r FROM valid WHERE log_index <= 2500) WHERE r = 1 AND op_type = 1""",
    "stream_latest": f"""SELECT {_S}, {_K}, max(log_index) AS log_index FROM wal_entry WHERE op_type IN (1, 2) AND key_bytes IS NOT NULL GROUP BY store_id, key_bytes""",
}
_FROM_RUNS = f"WITH {_RUNS} SELECT run AS sst_id, {_K}, coalesce(lower(hex(value_bytes)), '') AS value_hex, tombstone, ts FROM entries WHERE"
ORACLE_SQL |= {
    "sst_lookup": f"{_FROM_RUNS} key_bytes IN ('HB'::BLOB, 'cfg/feature-flags'::BLOB)",
    "sst_scan_range": f"{_FROM_RUNS} key_bytes >= 'cfg/'::BLOB AND key_bytes < 'q'::BLOB",
    "bloom_keys_kept": f"WITH {_RUNS} SELECT {_R}, entry_count AS n_keys, CAST(0 AS BIGINT) AS rejected FROM meta",
    "wal_payloads": """WITH valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, log_index ORDER BY coalesce(term, 0) DESC, op_type DESC) AS n
          FROM wal_entry WHERE op_type IN (1, 2) AND key_bytes IS NOT NULL) WHERE n = 1)
        SELECT CAST(store_id AS BIGINT) AS store_id, log_index, printf('%016x%016x%02x%04x', coalesce(term, 0), log_index, op_type, octet_length(key_bytes)) || lower(hex(key_bytes)) || coalesce(lower(hex(value_bytes)), '') AS payload_hex
        FROM valid""",
    "engine_manifest": f"""WITH {_VALID}, ends AS (SELECT min(log_index) + (max(log_index) - min(log_index)) * 4 // 5 AS cut FROM valid),
        keys AS (SELECT DISTINCT printf('%08x', store_id) || lower(hex(key_bytes)) AS k FROM valid, ends WHERE log_index <= cut)
        SELECT CAST(6 AS BIGINT) AS next_id, CAST(1 AS BIGINT) AS sst_level, count(*) AS entry_count, min(k) AS min_hex, max(k) AS max_hex FROM keys""",
    "engine_store": f"WITH {_LOG} SELECT {_S}, {_K}, {_V} FROM latest WHERE NOT tombstone",
    "engine_snapshot": f"WITH {_LOG} SELECT {_S}, {_K}, {_V} FROM latest WHERE NOT tombstone",
    "engine_multi_get": f"""WITH {_LOG} SELECT CAST(w.store_id AS BIGINT) AS store_id, lower(hex(w.key_bytes)) AS key_hex, lower(hex(e.value_bytes)) AS value_hex, e.store_id IS NOT NULL AS found
        FROM (SELECT DISTINCT store_id, key_bytes FROM kvpair_primary) w LEFT JOIN (SELECT * FROM latest WHERE NOT tombstone) e ON w.store_id = e.store_id AND w.key_bytes = e.key_bytes""",
    "engine_log_files": f"""WITH {_VALID} SELECT {_S}, {_K}, coalesce(lower(hex(value_bytes)), '') AS value_hex, row_number() OVER (ORDER BY log_index, store_id) AS log_index,
        CAST(op_type AS INTEGER) AS op_type FROM valid""",
}
