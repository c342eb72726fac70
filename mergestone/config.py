"""Settings of an engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Defaults and limits of the storage design.
MEMTABLE_BYTES = 4 << 20
WAL_SEGMENT_BYTES = 64 << 20
MAX_KEY_BYTES = 65_535
SPARSE_EVERY = 16
BLOOM_RATE = 0.01
L0_TRIGGER = 4
LEVELS = 7
MEMTABLE_OVERHEAD = 41
WAL_OVERHEAD = 27
RUN_OVERHEAD = 15


@dataclass(frozen=True)
class StorageConfig:
    data_dir: str
    wal_dir: str
    sst_dir: str
    memtable_bytes: int = MEMTABLE_BYTES
    wal_segment_bytes: int = WAL_SEGMENT_BYTES
    #: Whether the commit of a batch waits until it is on disk; there is no sync for each record.
    sync_writes: bool = True

    def ensure_dirs(self, spark: SparkSession) -> None:
        from mergestone.sources import files

        for d in (self.data_dir, self.wal_dir, self.sst_dir):
            files.make_dirs(spark, d)


def default_config(data_dir: str) -> StorageConfig:
    data_dir = data_dir.rstrip("/")
    return StorageConfig(data_dir, f"{data_dir}/wal", f"{data_dir}/sst")
