"""Spark session, and the folder that all executors share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mergestone.errors import NoSharedFolder

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName("mergestone")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; a cluster is an error, as
    its executors would each write to a disk of their own."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise NoSharedFolder(f"set {CHECKPOINT_DIR} to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="mergestone-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


_written: list[str] = []


_folders: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the application ends."""
    from mergestone.sources.files import delete_on_exit

    folder = f"{shared_root(spark)}/mergestone/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        delete_on_exit(spark, folder)
        _folders.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what this process wrote to the shared folder (after the first ``since`` paths). Frames that read it must not be used any more."""
    from mergestone.sources.files import delete

    while len(_written) > since:
        delete(spark, _written.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside the block is deleted at its end, so results must be written or collected in it."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    It cuts the lineage at a point where the rows are needed more than once; unlike a cached or locally
    checkpointed frame the table survives the loss of any executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session: at least so many tasks keep the cluster busy."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of input files for each task behind a shuffle.
TASK_BYTES = 128 << 20
#: More tasks than this cost the driver more than they save.
MOST_TASKS = 100_000


#: What the optimizer says of a relation whose size it doesn't know is beyond this.
_UNKNOWN = 1 << 60


def tasks_for(*frames: DataFrame) -> int:
    """Tasks for a shuffle of these frames: the session's number, more where the size of the files they read asks for it. Runs no job."""
    size = 0
    for f in frames:
        leaves = f._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        size += sum(n for n in sizes if n < _UNKNOWN)
    return max(parallelism(frames[0].sparkSession), min(MOST_TASKS, math.ceil(size / TASK_BYTES)))


@contextmanager
def shuffle_tasks(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Plans that start in the block shuffle into so many tasks. It makes room for aggregations that combine before the shuffle,
    which an explicit repartitioning would forgo."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(tasks))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="mergestone-code-")) / "mergestone_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, Path(package.name) / p.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
