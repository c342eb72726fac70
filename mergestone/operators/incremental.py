"""Processing only new or changed records (problem 6)."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.errors import ConcurrentUpdate
from mergestone.operators.log_records import counting_records, micros, valid_records
from mergestone.session import materialize
from mergestone.sources import files

#: Bytes of a file that a task holds while it takes the file's checksum.
READ_BYTES = 1 << 20
#: Files of a batch, about: a run with more is dealt into several by hash, so the driver never holds more names than these.
BATCH_FILES = 10_000
LISTING = "path string, size long, modified timestamp, checksum string"
#: ``file_no`` tells which records are the file's; ``line_no`` counts all lines, so the greatest is a path's newest.
MANIFEST = LISTING + ", file_no long, line_no long"
#: A record as it is kept, with the number of the file it came from.
KEPT = "store_id int, log_index long, term long, op_type tinyint, key_bytes binary, value_bytes binary, arrived_at timestamp_ntz, file_no long"


def _checksums(batches: Iterator) -> Iterator:
    """Streams each file through MD5, a block at a time."""
    import pyarrow as pa

    from mergestone.sources.readers import open_fs

    for b in batches:
        sums = []
        for path in b.column(0).to_pylist():
            where, inner = open_fs(path)
            digest = hashlib.md5(usedforsecurity=False)
            with where.open_input_stream(inner) as f:
                while block := f.read(READ_BYTES):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], names=[*b.schema.names, "checksum"])


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, size, modified) of the files at path, a folder or a file. No file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def with_checksums(listing: DataFrame) -> DataFrame:
    """Adds the MD5 of each file, taken on the executors, without holding a file in memory."""
    return listing.mapInArrow(_checksums, LISTING)


class IncrementalLog:
    """Takes in the files of a log that are new or changed since the last committed run.

    State, all under ``root``: ``listings/<batch>`` names a batch's files with size, time and checksum, ``data/<batch>`` has their
    records, each with its file's number, and ``manifest`` is the versioned document of the committed batches. A run lists the
    input, anti-joins the listing with the manifest, writes the records of the rest under an identifier that depends on
    those files only, and commits by adding it to the manifest. Data without a committed batch is never read and is replaced by the
    next attempt, so a run that failed at any point is repeated without a gap and without a repetition. A batch is committed once;
    of two runs at the same time one is committed and the other fails with ConcurrentUpdate.

    Only the listing is read to find what may have changed: a file whose path, size and time are in the manifest isn't opened.
    What differs is told apart by its checksum: a file with the bytes it had is only noted under its new time. ``full_check`` takes
    all checksums, for storage whose times can't be relied on.

    A file that was rewritten supersedes its older self: the records of that are no longer read. A file that is gone keeps
    its records, as a log's files may be cleared away once they are processed; with ``follow_removals`` they are dropped. No new
    files: nothing is written and ``run`` gives no batch.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.document = files.Document(spark, f"{root}/manifest")

    # -------------------------------------------------------------------------------- what is committed
    def _committed(self) -> list[dict]:
        return (self.document.load()[1] or {"batches": []})["batches"]

    def batches(self) -> list[str]:
        """Identifiers of the committed batches, in their order."""
        return [b["id"] for b in self._committed()]

    def manifest(self, batches: list[dict] | None = None) -> DataFrame:
        """The newest line of each path. A file that was dropped has a null size."""
        lines = [b["listing"] for b in (self._committed() if batches is None else batches)]
        if not lines:
            return self.spark.createDataFrame([], MANIFEST)
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        rows = self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/listings/{x}" for x in lines])
        if len(lines) == 1:  # a batch has a path once
            return rows
        return rows.groupBy("path").agg(F.max_by(F.struct(*names[1:]), "line_no").alias("r")).select("path", "r.*")

    def pending(self, path: str, full_check: bool = False, follow_removals: bool = False) -> DataFrame:
        """Lines that the manifest lacks: (path, size, modified, checksum, known), ``known`` if the bytes are those it had."""
        there, done = list_files(self.spark, path), self._committed()
        if not done:
            return with_checksums(there).withColumn("known", F.lit(None).cast("long"))
        known = self.manifest(done).withColumnRenamed("checksum", "old")
        fresh = there if full_check else there.join(known, ["path", "size", "modified"], "left_anti")
        fresh = with_checksums(fresh).join(known.select("path", "old", "file_no", F.col("modified").alias("before")), "path", "left")
        same = F.coalesce(F.col("old") == F.col("checksum"), F.lit(False))
        if full_check:
            fresh = fresh.where(~same | (F.col("before") != F.col("modified")))
        columns = [c.split()[0] for c in LISTING.split(", ")]
        fresh = fresh.select(*columns, F.when(same, F.col("file_no")).alias("known"))
        if follow_removals:
            gone = known.where(F.col("size").isNotNull()).join(there, "path", "left_anti")
            fresh = fresh.unionByName(gone.select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("modified", "timestamp"), ("checksum", "string"), ("known", "long"))]))
        return fresh

    # -------------------------------------------------------------------------------- a run
    def run(self, path: str, full_check: bool = False, follow_removals: bool = False, batch_files: int = BATCH_FILES, fail_before_commit: bool = False) -> list[str]:
        """Processes what is new at path; returns the identifiers of the batches it committed. ``fail_before_commit`` is for tests of recovery."""
        version, now = self.document.load()
        done, number = (list(now["batches"]), now["next"]) if now else ([], 1)
        listing = materialize(self.pending(path, full_check, follow_removals), "pending")
        n, committed = listing.count(), []
        parts = max(1, math.ceil(n / batch_files))
        for part in range(parts if n else 0):
            lines = listing.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part).orderBy("path").collect()  # about BATCH_FILES at most
            if not lines:
                continue
            entry = self._write_batch(lines, number, done)
            if fail_before_commit:
                raise RuntimeError("stopped before the commit")
            if not self.document.commit(version, {"batches": [*done, entry], "next": number + 1}):
                raise ConcurrentUpdate(self.root)
            done, version, number, committed = [*done, entry], version + 1, number + 1, [*committed, entry["id"]]
        return committed

    def _write_batch(self, lines: list, number: int, done: list[dict]) -> dict:
        """Writes a batch's records and listing under its identifier, in place of what an earlier attempt left there."""
        digest = hashlib.md5("\n".join(f"{r.path}|{r.size}|{r.modified}|{r.checksum}" for r in lines).encode(), usedforsecurity=False)
        batch = f"{number:08d}-{digest.hexdigest()}"
        for kind in ("data", "listings"):
            for old in files.children(self.spark, f"{self.root}/{kind}"):
                if old.startswith(batch):
                    files.delete(self.spark, f"{self.root}/{kind}/{old}")
        name = f"{batch}-{uuid.uuid4().hex[:8]}"
        # a file with the bytes it had keeps its number, so that the records it gave stay in force
        numbered = [(r.path, r.size, r.modified, r.checksum, (number << 32) + i if r.known is None else r.known, (number << 32) + i) for i, r in enumerate(lines)]
        listing = self.spark.createDataFrame(numbered, MANIFEST)
        wanted = [r.path for r in lines if r.known is None and r.size is not None]
        if wanted:
            rows = self.spark.read.parquet(*wanted)
            numbers = listing.select(_plain(F.col("path")).alias("_p"), "file_no")
            kept = counting_records(rows.withColumn("_p", _plain(rows.metadataColumn("_metadata").getField("file_path"))))
            # one line for each of a batch's files
            kept = kept.drop("file_no").join(F.broadcast(numbers), "_p").withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))
            kept.select([c.split()[0] for c in KEPT.split(", ")]).write.parquet(f"{self.root}/data/{name}")
        listing.coalesce(1).write.parquet(f"{self.root}/listings/{name}")
        fresh = listing.where(F.col("file_no") == F.col("line_no"))
        superseded = fresh.join(self.manifest(done), "path", "left_semi").count() if done else 0
        return {"id": batch, "listing": name, "data": name if wanted else None, "superseded": superseded}

    # -------------------------------------------------------------------------------- what was taken in
    def _rows(self, batches: list[dict], every: list[dict] | None = None) -> DataFrame:
        """The kept records of batches, without those of files that ``every`` (by default the same batches) have superseded."""
        paths = [f"{self.root}/data/{b['data']}" for b in batches if b["data"]]
        if not paths:
            return self.spark.createDataFrame([], KEPT)
        rows, every = self.spark.read.schema(KEPT).parquet(*paths), batches if every is None else every
        if any(b["superseded"] for b in every):
            live = self.manifest(every).where(F.col("size").isNotNull()).select("file_no")
            rows = rows.join(live, "file_no", "left_semi")
        return rows

    def records(self) -> DataFrame:
        """The valid records of all committed batches, with ``arrived_us``; one shuffle by (store, index)."""
        return valid_records(self._rows(self._committed()), arrival=True)

    def added(self, since: int) -> DataFrame:
        """The valid records that the batches after the first ``since`` added or changed: what a consumer of these batches must process.

        A record counts if it was not there before them or differs in term, type, key or value; one that a rewritten file took
        back is none. Of what was there before, only indexes that the new batches touch are resolved again.
        """
        done = self._committed()
        before, after = done[:since], done[since:]
        touched = self._rows(after, done).select("store_id", "log_index")
        if any(b["superseded"] for b in after):  # what a superseded record hid may come back
            live = self.manifest(done).where(F.col("size").isNotNull()).select("file_no")
            touched = touched.unionByName(self._rows(before).join(live, "file_no", "left_anti").select("store_id", "log_index"))
        touched, fields = touched.distinct(), ["store_id", "log_index", "term", "op_type", "key_bytes", "value_bytes"]
        only = lambda rows: valid_records(rows.join(touched, ["store_id", "log_index"], "left_semi"), arrival=True)
        old = only(self._rows(before)).select(fields)
        new = only(self._rows(done))
        same = [new[c].eqNullSafe(old[c]) for c in fields]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        return new.join(old, condition, "left_anti")

    def merge(self) -> None:
        """Replaces all batches by one: without superseded records and, within a file, repeated ones; their folders are deleted.

        So what a run reads grows with what is in force, not with the history. Readers of the replaced batches must be done.
        """
        version, now = self.document.load()
        done = now["batches"] if now else []
        if len(done) < 2:
            return
        name = f"merged-{uuid.uuid4().hex}"
        best = self._rows(done).groupBy("file_no", "store_id", "log_index").agg(
            F.max(F.struct("term", (-micros("arrived_at")).alias("early"), "op_type", "key_bytes", "value_bytes", "arrived_at")).alias("r")
        )
        best.select("store_id", "log_index", "r.term", "r.op_type", "r.key_bytes", "r.value_bytes", "r.arrived_at", "file_no").write.parquet(f"{self.root}/data/{name}")
        self.manifest(done).select([c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{self.root}/listings/{name}")
        entry = {"id": name, "listing": name, "data": name, "superseded": 0}
        if not self.document.commit(version, {"batches": [entry], "next": now["next"]}):
            for kind in ("data", "listings"):
                files.delete(self.spark, f"{self.root}/{kind}/{name}")
            raise ConcurrentUpdate(self.root)
        for b in done:
            for kind, folder in (("data", b["data"]), ("listings", b["listing"])):
                if folder:
                    files.delete(self.spark, f"{self.root}/{kind}/{folder}")


def _plain(path: Column) -> Column:
    """A file's URI without the slashes that differ between Spark's listings."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def marks_in_force(wal_meta: DataFrame) -> DataFrame:
    """(store_id, truncated_before, saved_us): for each store the committed mark of the greatest save_seq; null marks never count.

    Repeated rows are one; of differing rows with the same save_seq the greater mark counts, then the later one.
    """
    good = wal_meta.where(F.col("committed") & F.col("truncated_before").isNotNull() & F.col("store_id").isNotNull())
    best = good.groupBy("store_id").agg(F.max(F.struct("save_seq", "truncated_before", micros("saved_at").alias("saved_us"))).alias("m"))
    return best.select("store_id", "m.truncated_before", "m.saved_us")


def due_records(records: DataFrame, wal_meta: DataFrame) -> DataFrame:
    """The records the next run must process: of stores without a mark, above the mark, or arrived after it was saved.

    The marks are joined by store. Spark broadcasts them only while their measured size is below its threshold;
    beyond it the join shuffles and splits the partitions of hot stores.
    """
    joined = records.join(marks_in_force(wal_meta), "store_id", "left")
    due = F.col("truncated_before").isNull() | (F.col("log_index") > F.col("truncated_before")) | (F.col("arrived_us") > F.col("saved_us"))
    return joined.where(due).drop("truncated_before", "saved_us")
