"""The log as a stream: ordered replay into keyed state, whatever the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergestone.operators.log_records import counting_records
from mergestone.session import shared_path
from mergestone.sources.files import is_file

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

UPDATES = "store_id int, key_bytes binary, log_index long, op_type tinyint, value_bytes binary"


def updates(log: DataFrame) -> DataFrame:
    """A streaming frame of log rows -> the latest record of each key as it changes (update mode).

    State is one record a key, kept in RocksDB. Records are compared by index, then term: one that arrives late or again
    never undoes a later one. There is no watermark, as the log never forgets a key.
    """
    latest = F.max(F.struct("log_index", "term", "op_type", "value_bytes")).alias("r")
    state = counting_records(log).groupBy("store_id", "key_bytes").agg(latest)
    return state.select("store_id", "key_bytes", "r.log_index", "r.op_type", "r.value_bytes")


def replay(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int | None = None) -> int:
    """Processes what is new at path since the checkpoint and appends the keys' changes to ``out``; returns the number of batches.

    A micro-batch writes under its own number, over what a failed attempt left, so a repeated one adds nothing. It becomes durable
    as a whole when the checkpoint is committed.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if is_file(spark, path):  # a stream is of a folder; this one has a single file of interest
        reader, path = reader.option("pathGlobFilter", name), folder
    batches = []

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        query = updates(reader.parquet(path)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return len(batches)


def state_of(spark: SparkSession, out: str) -> DataFrame:
    """The latest record of each key over all batches, tombstones included."""
    rows = spark.read.schema(UPDATES + ", batch int").parquet(out)
    best = rows.groupBy("store_id", "key_bytes").agg(F.max(F.struct("log_index", "batch", "op_type", "value_bytes")).alias("r"))
    return best.select("store_id", "key_bytes", "r.log_index", "r.op_type", "r.value_bytes")


def latest_by_stream(spark: SparkSession, path: str) -> DataFrame:
    out, checkpoint = shared_path(spark, "stream-out"), shared_path(spark, "stream-checkpoint")
    replay(spark, path, out, checkpoint)
    return state_of(spark, out)
