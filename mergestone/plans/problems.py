"""Queries of problems 1 to 6 over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.operators import archive, change_feed, copy_diff, hot_keys, incremental, seen_keys
from mergestone.operators.log_records import micros
from mergestone.session import shared_path
from mergestone.sources import files


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _hex(c: str) -> F.Column:
    return F.lower(F.hex(c)).alias("key_hex")


# 1 -------------------------------------------------------------------------------------------------
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return seen_keys.already_seen(_read(spark, sf, "sst_entry"), _read(spark, sf, "kvpair_put"), "put_id").select(F.col("at").alias("put_id"))


def p1_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return seen_keys.error_rate(_read(spark, sf, "sst_entry"), _read(spark, sf, "kvpair_put"), "put_id")


# 2 -------------------------------------------------------------------------------------------------
def _archive(spark: SparkSession, sf: str) -> DataFrame:
    return archive.pack_archive(_read(spark, sf, "sst_info"), _read(spark, sf, "sst_entry"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return archive.small_files(_archive(spark, sf))


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each listed file."""
    return archive.archived_files(_archive(spark, sf)).select("sst_level", "sst_id", "versions", "stored")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records read back from the archive, checksums verified."""
    rows = archive.unpack_archive(_archive(spark, sf))
    return rows.select(F.col("store_id").cast("long").alias("store_id"), "sst_level", "sst_id", _hex("key_bytes"), "ts", "log_index", "tombstone", F.lower(F.hex("value_bytes")).alias("value_hex"))


# 3 -------------------------------------------------------------------------------------------------
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hot_keys.hot_keys(_read(spark, sf, "wal_entry"), _read(spark, sf, "kvpair_put")).select("table_name", _hex("key_bytes"))


def p3_per_key(spark: SparkSession, sf: str) -> DataFrame:
    totals, _ = hot_keys.per_key(_read(spark, sf, "wal_entry"), _read(spark, sf, "kvpair_put"))
    return totals.select("table_name", _hex("key_bytes"), F.col("rows").alias("n_rows"), "puts", "deletes", "value_bytes")


# 4 -------------------------------------------------------------------------------------------------
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    d = copy_diff.diff_copies(_read(spark, sf, "kvpair_primary"), _read(spark, sf, "kvpair_replica"))
    return d.select(F.col("store_id").cast("long").alias("store_id"), _hex("key_bytes"), "diff")


# 5 -------------------------------------------------------------------------------------------------
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    state = change_feed.current_state(_read(spark, sf, "wal_entry"), _read(spark, sf, "sst_entry"))
    return change_feed.live(state, F.col("store_id").cast("long").alias("store_id"), _hex("key_bytes"), F.col("seq").alias("log_index"))


def p5_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of p5_found after five calls that find each other's published state."""
    state = change_feed.state_in_batches(_read(spark, sf, "wal_entry"), _read(spark, sf, "sst_entry"))
    return change_feed.live(state, F.col("store_id").cast("long").alias("store_id"), _hex("key_bytes"), F.col("seq").alias("log_index"))


# 6 -------------------------------------------------------------------------------------------------
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The records due after a first run; a second one must find all files in the manifest."""
    log = incremental.IncrementalLog(spark, shared_path(spark, "incremental"))
    log.run(f"{sf}/wal_entry.parquet")
    if log.run(f"{sf}/wal_entry.parquet"):
        raise RuntimeError("a file was taken in twice")
    return _due(spark, sf, log)


def _due(spark: SparkSession, sf: str, log: incremental.IncrementalLog) -> DataFrame:
    due = incremental.due_records(log.records(), _read(spark, sf, "wal_meta"))
    return due.select(F.col("store_id").cast("long").alias("store_id"), "log_index")


def _after_three_runs(spark: SparkSession, sf: str) -> incremental.IncrementalLog:
    """A log whose rows arrive in three shares, by the microsecond of arrival, as files of a folder.

    The first run meets the first share and, under a name of the third, rows that never were; it fails before its commit and is
    repeated. The second meets the second share. The third meets the third share where the wrong rows were.
    """
    wal, folder = _read(spark, sf, "wal_entry"), shared_path(spark, "incremental-input")
    log = incremental.IncrementalLog(spark, shared_path(spark, "incremental"))
    share = F.pmod(micros("arrived_at"), F.lit(3))

    def put(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}-{name}")
        files.make_dirs(spark, folder)
        parts = [n for n in files.children(spark, f"{folder}-{name}") if n.endswith(".parquet")]
        for i, n in enumerate(parts):
            files.delete(spark, f"{folder}/{name}-{i:06d}.parquet")
            files.rename(spark, f"{folder}-{name}/{n}", f"{folder}/{name}-{i:06d}.parquet")
        files.delete(spark, f"{folder}-{name}")

    put(wal.where(share == 0), "a")
    put(wal.where(share == 1).withColumns({"log_index": -F.col("log_index"), "term": F.lit(1 << 40).cast("long")}), "c")
    try:
        log.run(folder, fail_before_commit=True)
    except RuntimeError:
        pass
    log.run(folder)
    put(wal.where(share == 1), "b")
    log.run(folder, batch_files=2)
    put(wal.where(share == 2), "c")
    log.run(folder)
    return log


def p6_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of p6_found, taken in by several runs: one failed, some files new and some rewritten between them."""
    return _due(spark, sf, _after_three_runs(spark, sf))


def p6_added(spark: SparkSession, sf: str) -> DataFrame:
    """What the last run added or changed: of records that three shares of the log give, those that two of them don't."""
    log = _after_three_runs(spark, sf)
    added = log.added(len(log.batches()) - 1)
    return added.select(F.col("store_id").cast("long").alias("store_id"), "log_index", "term", F.col("op_type").cast("int").alias("op_type"), _hex("key_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_error_rate, p2_found, p2_files, p2_records, p3_found, p3_per_key, p4_found, p5_found, p5_batches, p6_found, p6_runs, p6_added)
}

_LISTED = """
listed AS (SELECT DISTINCT try_cast(regexp_extract(sst_path, '(?:^|[/\\\\])([0-9]+)\\.sst\\s*$', 1, 'i') AS BIGINT) AS sst_id FROM sst_info),
versions AS (
  SELECT store_id, key_bytes, ts, lvl, num, max(log_index) AS log_index, arg_max(coalesce(tombstone, false), log_index) AS tombstone,
         max(CASE WHEN n = 1 THEN value_bytes END) AS value_bytes
  FROM (SELECT store_id, key_bytes, ts, log_index, tombstone, value_bytes,
               try_cast(regexp_extract(sst_path, 'L([0-9]+)/[^/]*$', 1) AS BIGINT) AS lvl, try_cast(regexp_extract(sst_path, '([0-9]+)\\.sst$', 1) AS BIGINT) AS num,
               row_number() OVER (PARTITION BY sst_path, store_id, key_bytes, ts ORDER BY log_index DESC, tombstone DESC, value_bytes DESC NULLS LAST) AS n
        FROM sst_entry)
  WHERE num IN (SELECT sst_id FROM listed WHERE sst_id IS NOT NULL)
  GROUP BY store_id, key_bytes, ts, lvl, num),
owned AS (SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes, ts ORDER BY lvl DESC, num DESC) = 1 AS owner FROM versions)
"""
_VALID = """
valid AS (
  SELECT store_id, log_index, op_type, key_bytes, value_bytes, first_arrival FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, log_index ORDER BY coalesce(term, 0) DESC, arrived_at, op_type DESC) AS n,
           min(arrived_at) OVER (PARTITION BY store_id, log_index, coalesce(term, 0)) AS first_arrival
    FROM wal_entry WHERE op_type IN (1, 2) AND key_bytes IS NOT NULL)
  WHERE n = 1)
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": """
        WITH firsts AS (SELECT key_bytes, min(put_id) AS first_id FROM kvpair_put WHERE key_bytes IS NOT NULL GROUP BY key_bytes)
        SELECT p.put_id FROM kvpair_put p JOIN firsts f ON p.key_bytes = f.key_bytes
        WHERE p.put_id > f.first_id OR p.key_bytes IN (SELECT key_bytes FROM sst_entry)""",
    "p2_found": f"WITH {_LISTED} SELECT lvl AS sst_level, num AS sst_id FROM versions GROUP BY lvl, num HAVING count(*) < 64",
    "p2_files": f"WITH {_LISTED} SELECT lvl AS sst_level, num AS sst_id, count(*) AS versions, count(*) FILTER (owner) AS stored FROM owned GROUP BY lvl, num",
    "p2_records": f"""WITH {_LISTED} SELECT CAST(store_id AS BIGINT) AS store_id, lvl AS sst_level, num AS sst_id, lower(hex(key_bytes)) AS key_hex, ts, log_index, tombstone,
        lower(hex(value_bytes)) AS value_hex FROM owned WHERE owner""",
    "p3_found": """
        SELECT 'wal_entry' AS table_name, lower(hex(key_bytes)) AS key_hex FROM wal_entry WHERE key_bytes IS NOT NULL
        GROUP BY key_bytes HAVING count(*) >= 0.02 * (SELECT count(*) FROM wal_entry)
        UNION ALL SELECT 'kvpair_put', lower(hex(key_bytes)) FROM kvpair_put WHERE key_bytes IS NOT NULL
        GROUP BY key_bytes HAVING count(*) >= 0.02 * (SELECT count(*) FROM kvpair_put)""",
    "p3_per_key": """
        SELECT 'wal_entry' AS table_name, lower(hex(key_bytes)) AS key_hex, count(*) AS n_rows, count(*) FILTER (op_type = 1) AS puts, count(*) FILTER (op_type = 2) AS deletes,
               CAST(coalesce(sum(octet_length(value_bytes)), 0) AS BIGINT) AS value_bytes
        FROM wal_entry WHERE key_bytes IS NOT NULL GROUP BY key_bytes
        UNION ALL
        SELECT 'kvpair_put', lower(hex(key_bytes)), count(*), count(*) FILTER (NOT tombstone), count(*) FILTER (tombstone), CAST(coalesce(sum(octet_length(value_bytes)), 0) AS BIGINT)
        FROM kvpair_put WHERE key_bytes IS NOT NULL GROUP BY key_bytes""",
    "p4_found": """
        WITH p AS (SELECT * FROM kvpair_primary QUALIFY row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY log_index DESC) = 1),
        r AS (SELECT * FROM kvpair_replica QUALIFY row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY log_index DESC) = 1),
        b AS (SELECT coalesce(p.store_id, r.store_id) AS store_id, coalesce(p.key_bytes, r.key_bytes) AS key_bytes, p.store_id IS NULL AS no_p, r.store_id IS NULL AS no_r,
                     coalesce(p.value_bytes, ''::BLOB) IS DISTINCT FROM coalesce(r.value_bytes, ''::BLOB) AS dv, p.term IS DISTINCT FROM r.term AS dt, p.tombstone IS DISTINCT FROM r.tombstone AS dd
              FROM p FULL JOIN r ON p.store_id = r.store_id AND p.key_bytes = r.key_bytes)
        SELECT CAST(store_id AS BIGINT) AS store_id, lower(hex(key_bytes)) AS key_hex, d AS diff FROM (
          SELECT store_id, key_bytes, unnest(CASE WHEN no_r THEN ['only_primary'] WHEN no_p THEN ['only_replica']
            ELSE list_filter([CASE WHEN dv THEN 'value' END, CASE WHEN dt THEN 'term' END, CASE WHEN dd THEN 'tombstone' END], lambda x: x IS NOT NULL) END) AS d FROM b)""",
    "p5_found": f"""
        WITH {_VALID}, changes AS (
          SELECT store_id, key_bytes, log_index, op_type = 2 AS deleted FROM valid
          UNION ALL SELECT store_id, key_bytes, log_index, coalesce(tombstone, false) FROM sst_entry WHERE key_bytes IS NOT NULL)
        SELECT CAST(store_id AS BIGINT) AS store_id, lower(hex(key_bytes)) AS key_hex, log_index FROM (
          SELECT *, row_number() OVER (PARTITION BY store_id, key_bytes ORDER BY log_index DESC, deleted DESC) AS n FROM changes) WHERE n = 1 AND NOT deleted""",
    "p6_found": f"""
        WITH {_VALID}, marks AS (
          SELECT store_id, truncated_before, saved_at FROM wal_meta WHERE committed AND truncated_before IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY save_seq DESC, truncated_before DESC, saved_at DESC) = 1)
        SELECT CAST(v.store_id AS BIGINT) AS store_id, v.log_index FROM valid v LEFT JOIN marks m ON v.store_id = m.store_id
        WHERE m.store_id IS NULL OR v.log_index > m.truncated_before OR v.first_arrival > m.saved_at""",
}
ORACLE_SQL["p5_batches"] = ORACLE_SQL["p5_found"]
ORACLE_SQL["p6_runs"] = ORACLE_SQL["p6_found"]
_TAKEN = """SELECT store_id, log_index, coalesce(term, 0) AS term, op_type, key_bytes, value_bytes FROM wal_entry WHERE op_type IN (1, 2) AND key_bytes IS NOT NULL AND {}
  QUALIFY row_number() OVER (PARTITION BY store_id, log_index ORDER BY coalesce(term, 0) DESC, arrived_at, op_type DESC) = 1"""
ORACLE_SQL["p6_added"] = f"""
    WITH before AS ({_TAKEN.format("epoch_us(arrived_at) % 3 < 2")}), after AS ({_TAKEN.format("true")})
    SELECT CAST(a.store_id AS BIGINT) AS store_id, a.log_index, a.term, CAST(a.op_type AS INTEGER) AS op_type, lower(hex(a.key_bytes)) AS key_hex
    FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.store_id = a.store_id AND b.log_index = a.log_index AND b.term = a.term AND b.op_type = a.op_type
      AND b.key_bytes = a.key_bytes AND b.value_bytes IS NOT DISTINCT FROM a.value_bytes)"""
