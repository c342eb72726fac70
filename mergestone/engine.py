"""An engine over one key space: batches of puts and deletes, reads through all tiers, flush, compaction, recovery.

Everything is batch-wise: a batch of operations is one durable append to the log, a batch of keys one read. The methods for single
keys exist for completeness; each costs a Spark job.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.config import L0_TRIGGER, LEVELS, MAX_KEY_BYTES, MEMTABLE_OVERHEAD, WAL_OVERHEAD, StorageConfig, default_config
from mergestone.errors import ConcurrentUpdate, CorruptFile, EngineClosed, KeyTooLong
from mergestone.functions.layout import memtable_bytes, wal_bytes
from mergestone.operators.offsets import global_offsets
from mergestone.operators.versions import latest, live, resolve_by_version
from mergestone.sources import files
from mergestone.sources.manifest import Manifest

BATCH = "pos long, op_type tinyint, key_bytes binary, value_bytes binary"
LOG = "log_index long, op_type tinyint, key_bytes binary, value_bytes binary, segment int"
RUN = "key_bytes binary, value_bytes binary, tombstone boolean, log_index long"
_KEYS = ("key_bytes",)
#: A compaction that holds its guard for longer is taken for dead.
GUARD_SECONDS = 6 * 3600


class Engine:
    """Open it on a folder; it recovers what was committed there. Several handles, also of several drivers, may be open on one folder.

    Layout: ``wal/batch=<id>`` log batches (Parquet), ``wal/commits/<number>.json`` their order and indexes, ``wal/mark`` the
    truncation mark, ``wal/segments`` the number of the last segment, ``sst/L<level>/<number>.sst`` runs sorted by key,
    with key statistics and Bloom filters, and ``manifest``, the catalog. The log index is the version of a key: unique and total.

    A batch is written under a name of its own and then committed by creating the commit of the next number exclusively; who comes
    second takes the number and the indexes after it. So no acknowledged write is lost or numbered twice. Each
    handle appends to log segments of its own and starts another when one has ``wal_segment_bytes``.

    Differences from a single-node engine, on purpose: durability is per batch, not per record; flush and compaction run when
    called for, not in the background, so results don't depend on timing; a flush truncates the log.
    """

    def __init__(self, spark: SparkSession, config: StorageConfig | str) -> None:
        self.spark, self.config = spark, default_config(config) if isinstance(config, str) else config
        self.config.ensure_dirs(spark)
        self.manifest = Manifest(spark, self.config.data_dir)
        self.closed = False
        self._mark, self._segments = (files.Document(spark, f"{self.config.wal_dir}/{d}") for d in ("mark", "segments"))
        self._start_segment()

    # -------------------------------------------------------------------------------- log and memtable
    def _check(self) -> None:
        if self.closed:
            raise EngineClosed("the engine is closed")

    def _start_segment(self) -> None:
        self.segment = self._segments.update(lambda now: {"last": (now["last"] if now else 0) + 1})["last"]
        self._segment_bytes = 0

    @property
    def truncated_before(self) -> int:
        """The log's mark: records up to it are never replayed."""
        return (self._mark.load()[1] or {"truncatedBefore": 0})["truncatedBefore"]

    def _commit(self, number: int) -> dict:
        path = f"{self.config.wal_dir}/commits/{number:012d}.json"
        data = files.read_bytes(self.spark, path)
        try:
            return json.loads(data.decode())
        except (ValueError, AttributeError) as e:
            raise CorruptFile(path) from e

    def _last(self) -> tuple[int, int]:
        """(number of the last commit, its last index)."""
        there = [n for n in files.children(self.spark, f"{self.config.wal_dir}/commits") if n.endswith(".json")]
        if not there:
            return 0, 0
        number = int(there[-1][:-5])
        doc = self._commit(number)
        return number, doc["first"] + doc["n"] - 1

    @property
    def next_index(self) -> int:
        """The mark counts too, so that a log whose records are all truncated doesn't start again below it."""
        return 1 + max(self._last()[1], self.truncated_before)

    def _commits(self, above: int) -> list[dict]:
        """The commits with records above an index, from the last one back."""
        out, (number, _) = [], self._last()
        while number:
            doc = self._commit(number)
            if doc["first"] + doc["n"] - 1 <= above:
                break
            out.append(doc)
            number -= 1
        return out[::-1]

    def segments(self) -> list[dict]:
        """(segment, records, first, last, bytes) of the log segments above the mark."""
        out: dict[int, dict] = {}
        for c in self._commits(self.truncated_before):
            s = out.setdefault(c["segment"], {"segment": c["segment"], "records": 0, "first": c["first"], "last": 0, "bytes": 0})
            s.update(records=s["records"] + c["n"], last=c["first"] + c["n"] - 1, bytes=s["bytes"] + c["bytes"])
        return sorted(out.values(), key=lambda s: s["segment"])

    def log(self) -> DataFrame:
        """The log's records above the mark."""
        mark = self.truncated_before
        commits = self._commits(mark)
        if not commits:
            return self.spark.createDataFrame([], LOG)
        paths = [f"{self.config.wal_dir}/batch={c['batch']}" for c in commits]
        rows = self.spark.read.schema(f"{BATCH}, batch string").option("basePath", self.config.wal_dir).parquet(*paths)
        # one row for each commit that isn't flushed yet; the memtable's limit bounds their bytes, and each has a record
        firsts = self.spark.createDataFrame([(c["batch"], c["first"], c["segment"]) for c in commits], "batch string, first long, segment int")
        rows = rows.join(F.broadcast(firsts), "batch").withColumn("log_index", F.col("first") + F.col("pos"))
        return rows.where(F.col("log_index") > mark).select([c.split()[0] for c in LOG.split(", ")])

    def memtable(self) -> DataFrame:
        """Entries of the log above the mark: the latest of each key, tombstones kept."""
        tomb = F.col("op_type") == 2
        return latest(self.log().select("key_bytes", "log_index", tomb.alias("tombstone"), F.when(~tomb, F.col("value_bytes")).alias("value_bytes")), keys=_KEYS)

    def apply(self, ops: DataFrame, order: str) -> int:
        """Appends a batch of (key_bytes, value_bytes, delete) rows in the order of ``order`` and returns the last index.

        Later rows of a key win. Rows equal in ``order`` get a fixed but arbitrary order. A null key is an error, as is one longer than
        a key can be. An empty batch changes nothing. Then the memtable is flushed if it is full.
        """
        self._check()
        key, value = F.col("key_bytes"), F.col("value_bytes")
        facts = ops.agg(F.max(key.isNull()).alias("null"), F.max(F.octet_length(key)).alias("longest"), F.count(F.lit(1)).alias("n"), F.sum(wal_bytes(key, value)).alias("bytes")).first()
        if not facts["n"]:
            return self.next_index - 1
        if facts["null"] or facts["longest"] > MAX_KEY_BYTES:
            raise KeyTooLong("a null key" if facts["null"] else f"{facts['longest']} bytes")
        rows = ops.select(F.col(order).alias("_order"), "key_bytes", "value_bytes", F.when(F.coalesce("delete", F.lit(False)), 2).otherwise(1).cast("tinyint").alias("op_type"), F.lit(1).cast("long").alias("n"))
        placed = global_offsets(rows, ["_order", "key_bytes", "op_type", "value_bytes"]).select(F.col("start").alias("pos"), "op_type", "key_bytes", "value_bytes")
        batch = uuid.uuid4().hex
        placed.write.parquet(f"{self.config.wal_dir}/batch={batch}")
        last = self._append(batch, facts["n"], facts["bytes"])
        self._segment_bytes += facts["bytes"]
        if self._segment_bytes >= self.config.wal_segment_bytes:
            self._start_segment()
        if self.should_flush():
            self.flush()
        return last

    def _append(self, batch: str, n: int, size: int) -> int:
        """Commits a written batch behind the last one; returns its last index."""
        while True:
            number, last = self._last()
            first = 1 + max(last, self.truncated_before)
            doc = {"batch": batch, "first": first, "n": n, "bytes": size, "segment": self.segment}
            if files.create_new(self.spark, f"{self.config.wal_dir}/commits/{number + 1:012d}.json", json.dumps(doc).encode(), self.config.sync_writes):
                return first + n - 1

    def _one(self, key: bytes, value: bytes | None, delete: bool) -> int:
        return self.apply(self.spark.createDataFrame([(0, key, value, delete)], "at int, key_bytes binary, value_bytes binary, delete boolean"), "at")

    def put(self, key: bytes, value: bytes | None) -> int:
        return self._one(key, value, False)

    def delete(self, key: bytes) -> int:
        """Writes a tombstone; a key that isn't there may be deleted."""
        return self._one(key, None, True)

    def should_flush(self) -> bool:
        """Whether the memtable's live entries have reached its limit. They are summed up only if all records together could have."""
        if sum(c["bytes"] + (MEMTABLE_OVERHEAD - WAL_OVERHEAD) * c["n"] for c in self._commits(self.truncated_before)) < self.config.memtable_bytes:
            return False
        size = self.memtable().agg(F.sum(memtable_bytes(F.col("key_bytes"), F.col("value_bytes"))).alias("b")).first()["b"]
        return (size or 0) >= self.config.memtable_bytes

    def export_log(self, folder: str) -> None:
        """Writes the log above the mark as binary segment files of about ``wal_segment_bytes``, a task a segment."""
        from mergestone.sources.readers import register

        register(self.spark)
        sized = global_offsets(self.log().withColumn("n", wal_bytes(F.col("key_bytes"), F.col("value_bytes"))), ["log_index"])
        rows = sized.withColumn("segment", (F.col("start") / self.config.wal_segment_bytes).cast("int") + 1)
        rows = rows.select("segment", F.lit(0).cast("long").alias("term"), "log_index", "op_type", "key_bytes", "value_bytes")
        rows.repartition("segment").sortWithinPartitions("segment", "log_index").write.format("wal").mode("append").save(folder)

    def import_log(self, folder: str) -> int:
        """Applies what binary segment files hold, in the order of their indexes, each up to its first damaged record."""
        from mergestone.sources.readers import register

        register(self.spark)
        rows = self.spark.read.format("wal").load(folder).where(F.col("op_type").isin(1, 2))
        return self.apply(rows.select("log_index", "key_bytes", "value_bytes", (F.col("op_type") == 2).alias("delete")), "log_index")

    # -------------------------------------------------------------------------------- runs
    def _write_run(self, rows: DataFrame, level: int) -> dict:
        """A sorted run on disk. Range partitions are in key order, so its files don't overlap and their footers prune."""
        path = f"L{level}/{self.manifest.allocate():06d}.sst"
        columns = [c.split()[0] for c in RUN.split(", ")]
        out = rows.select(columns).repartitionByRange(F.col("key_bytes")).sortWithinPartitions("key_bytes")
        out.write.mode("overwrite").option("parquet.bloom.filter.enabled#key_bytes", "true").parquet(f"{self.config.sst_dir}/{path}")
        stats = self._read_run(path).agg(F.count(F.lit(1)).alias("n"), F.hex(F.min("key_bytes")).alias("low"), F.hex(F.max("key_bytes")).alias("high")).first()
        return {"path": path, "level": level, "entry_count": stats["n"], "min_key": stats["low"], "max_key": stats["high"]}

    def _read_run(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.config.sst_dir}/{path}")

    def _tiers(self, key: bytes | None = None) -> DataFrame:
        """All versions with tier and pos; for a single key only the runs whose range holds it are opened. A missing file is skipped.

        The mark is read before the catalog: a flush changes the catalog first, so nothing falls between the two.
        """
        h = key.hex().upper() if key is not None else None
        frames = [self.memtable().withColumn("tier", F.lit(-1)).withColumn("pos", F.lit(0))]
        self.manifest.load()
        for level in range(LEVELS):
            runs = self.manifest.level(level)
            there = {f"L{level}/{n}" for n in files.children(self.spark, f"{self.config.sst_dir}/L{level}")} if runs else set()
            for pos, run in enumerate(runs):
                if not run["entry_count"] or h is not None and not run["min_key"] <= h <= run["max_key"] or run["path"] not in there:
                    continue
                frames.append(self._read_run(run["path"]).withColumn("tier", F.lit(level)).withColumn("pos", F.lit(pos)))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def resolved(self, key: bytes | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The entry each key resolves to, tombstones included: first the memtable, then level 0 newest first, then the deeper levels.

        With a key, or a table of ``wanted`` keys, only their versions are resolved.
        """
        rows = self._tiers(key)
        if key is not None:
            rows = rows.where(F.col("key_bytes") == F.lit(key))
        if wanted is not None:
            rows = rows.join(wanted, "key_bytes", "left_semi")
        return latest(rows, (-F.col("tier"), F.col("pos")), _KEYS, ["value_bytes", "tombstone", "log_index", "tier"])

    def get(self, key: bytes) -> bytes | None:
        """The key's value; None if it isn't there or is deleted. A stored null comes back as an empty value."""
        self._check()
        row = live(self.resolved(key)).select("value_bytes").first()
        return None if row is None else bytes(row["value_bytes"] or b"")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key_bytes, value_bytes, found) for each distinct wanted key."""
        self._check()
        wanted = keys.select("key_bytes").distinct()
        state = live(self.resolved(wanted=wanted)).select("key_bytes", "value_bytes", F.lit(True).alias("found"))
        return wanted.join(state, "key_bytes", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def snapshot(self) -> DataFrame:
        """Live entries of the active memtable only."""
        self._check()
        return live(self.memtable()).select("key_bytes", "value_bytes")

    def full_snapshot(self) -> DataFrame:
        """Live entries of all tiers."""
        self._check()
        return live(self.resolved()).select("key_bytes", "value_bytes", "log_index")

    # -------------------------------------------------------------------------------- maintenance
    def truncate(self, after_index: int) -> None:
        """Moves the log's mark up; records up to it are never replayed again. Batches wholly below the mark before are deleted."""
        before = self.truncated_before
        doc = self._mark.update(lambda now: {**(now or {}), "truncatedBefore": max(after_index, now["truncatedBefore"] if now else 0)}, self.config.sync_writes)
        cleared, (number, _) = doc.get("cleared", 0), self._last()
        while cleared < number and (c := self._commit(cleared + 1))["first"] + c["n"] - 1 <= before:
            files.delete(self.spark, f"{self.config.wal_dir}/batch={c['batch']}")
            cleared += 1
        if cleared > doc.get("cleared", 0):
            self._mark.update(lambda now: {**now, "cleared": max(cleared, now.get("cleared", 0))})

    def flush(self) -> str | None:
        """Writes the memtable as a run of level 0, catalogs it, then truncates the log; compacts if level 0 is full.

        A crash between the steps leaves either an uncataloged file, which is never read, or records both in the run and in the
        log, which resolve to the same. If another handle has flushed as much already, its run counts and this one is dropped.
        """
        self._check()
        upto = self.next_index - 1
        if upto <= self.truncated_before:
            return None
        run = self._write_run(self.memtable(), 0)
        try:
            self.manifest.swap([run], [], flushed=upto)
        except ConcurrentUpdate:
            files.delete(self.spark, f"{self.config.sst_dir}/{run['path']}")
            self.truncate(self.manifest.flushed)
            return None
        self.truncate(upto)
        if len(self.manifest.level(0)) >= L0_TRIGGER:
            self.compact()
        return run["path"]

    def _guard(self, level: int) -> str | None:
        """The exclusive right to compact a level, as the path of a file; None if another compaction has it."""
        path = f"{self.config.sst_dir}/_compacting-L{level}"
        for _ in range(2):
            if files.create_new(self.spark, path, json.dumps({"at": time.time()}).encode()):
                return path
            held = files.read_bytes(self.spark, path)
            if held is not None and time.time() - json.loads(held.decode())["at"] < GUARD_SECONDS:
                return None
            files.delete(self.spark, path)
        return None

    def compact(self, level: int = 0, at_least: int = 1, drop_tombstones: bool = False) -> str | None:
        """Merges all runs of a level and the overlapping ones of the next into one run there; one catalog change.

        Nothing is done below ``at_least`` runs, below the last level, or while another compaction of the level is under way; should
        its inputs have been replaced meanwhile all the same, the merged run is dropped. Tombstones stay, as they hide
        older versions in deeper levels; with ``drop_tombstones``, an extension, they go where no deeper run reaches into the range.
        """
        self._check()
        self.manifest.load()
        source, target = self.manifest.level(level), level + 1
        if target >= LEVELS or len(source) < max(1, at_least) or (guard := self._guard(level)) is None:
            return None
        try:
            self.manifest.load()
            source = self.manifest.level(level)
            if len(source) < max(1, at_least):
                return None
            low, high = min(r["min_key"] for r in source), max(r["max_key"] for r in source)
            overlaps = lambda r: r["min_key"] <= high and r["max_key"] >= low
            chosen = source + [r for r in self.manifest.level(target) if overlaps(r)]
            low, high = min(r["min_key"] for r in chosen), max(r["max_key"] for r in chosen)
            rows = None
            for i, r in enumerate(chosen):
                one = self._read_run(r["path"]).withColumn("run", F.lit(i)).withColumn("ts", F.col("log_index"))
                rows = one if rows is None else rows.unionByName(one)
            merged = resolve_by_version(rows, _KEYS)
            if drop_tombstones and not any(overlaps(r) for n in range(target + 1, LEVELS) for r in self.manifest.level(n)):
                merged = live(merged)
            run = self._write_run(merged, target)
            try:
                self.manifest.swap([run] if run["entry_count"] else [], [r["path"] for r in chosen])
            except ConcurrentUpdate:
                files.delete(self.spark, f"{self.config.sst_dir}/{run['path']}")
                return None
            for path in [r["path"] for r in chosen] + ([] if run["entry_count"] else [run["path"]]):
                files.delete(self.spark, f"{self.config.sst_dir}/{path}")
            return run["path"] if run["entry_count"] else None
        finally:
            files.delete(self.spark, guard)

    def remove_run(self, path: str) -> bool:
        """Takes a run out of the catalog and deletes its file; False if it isn't there."""
        there = self.manifest.remove(path)
        files.delete(self.spark, f"{self.config.sst_dir}/{path}")
        return there

    def close(self) -> None:
        """Further operations are errors; closing again is not."""
        self.closed = True
