"""Files in the shared folder through Hadoop's file systems: exclusive creation, versioned documents, published tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mergestone.errors import ConcurrentUpdate, CorruptFile


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _fs(spark: SparkSession, path: str):
    p = _jvm(spark).org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Makes a folder that the driver's JVM deletes as it ends."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; none if it is missing."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder; an error if the target is there already or the file system refuses."""
    fs, src = _fs(spark, source)
    if exists(spark, target) or not fs.rename(src, _fs(spark, target)[1]):
        raise ConcurrentUpdate(f"{source} couldn't become {target}")


def _is_local(fs) -> bool:
    return fs.getUri().getScheme() == "file"


def create_new(spark: SparkSession, path: str, data: bytes, sync: bool = True) -> bool:
    """Creates a file with these bytes in one step; False, and nothing changes, if there is one already.

    Of several writers exactly one succeeds: on a local file system by a hard link, elsewhere by a rename, which HDFS and file
    systems like it refuse, as one atomic step, where the target exists. ``sync`` waits until the bytes are on disk.
    """
    fs, target = _fs(spark, path)
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs.mkdirs(target.getParent())
    if _is_local(fs):
        here, there = (_fs(spark, x)[1].toUri().getPath() for x in (part, path))
        with open(here, "wb") as f:
            f.write(data)
            if sync:
                f.flush()
                os.fsync(f.fileno())
        try:
            os.link(here, there)
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
        return True
    source = _fs(spark, part)[1]
    out = fs.create(source, False)
    out.write(bytearray(data))
    if sync:
        out.hsync()
    out.close()
    done = not fs.exists(target) and fs.rename(source, target)
    if not done:
        fs.delete(source, False)
    return done


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(_jvm(spark).org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


class Document:
    """A small JSON document that several writers may change. Each version is a file of its own, created once and never changed.

    A change is read, made and committed against the version it was read from; if another writer was first, the commit fails and
    the change is made anew on what that one wrote. So no change is lost and readers see whole versions. The last
    ``KEEP`` versions stay.
    """

    KEEP = 32

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in children(self.spark, self.folder) if n.endswith(".json")]

    def path(self) -> str | None:
        """The file of the newest version."""
        there = self.versions()
        return self._path(there[-1]) if there else None

    def load(self) -> tuple[int, dict | None]:
        """(version, document); (0, None) if there is none. A damaged one is an error, not an empty one."""
        while True:
            there = self.versions()
            if not there:
                return 0, None
            data = read_bytes(self.spark, self._path(there[-1]))
            if data is not None:  # else it was dropped as too old since it was listed
                try:
                    return there[-1], json.loads(data.decode())
                except ValueError as e:
                    raise CorruptFile(self._path(there[-1])) from e

    def commit(self, version: int, document: dict, sync: bool = True) -> bool:
        """Makes document the version after ``version``; False if there is a later one already."""
        mine = self._path(version + 1)
        if (there := self.versions()) and there[-1] > version or not create_new(self.spark, mine, json.dumps(document).encode(), sync):
            return False
        there = self.versions()
        if there[-1] > version + 1 and version + 2 not in there:  # it took the place of a version dropped long ago
            delete(self.spark, mine)
            return False
        for old in there[: -self.KEEP]:
            delete(self.spark, self._path(old))
        return True

    def update(self, change: Callable[[dict | None], dict], sync: bool = True) -> dict:
        """Applies ``change`` to the newest version until it can be committed; ``change`` may raise to give up."""
        while True:
            version, now = self.load()
            new = change(now)
            if self.commit(version, new, sync):
                return new


def _published(spark: SparkSession, root: str) -> Document:
    return Document(spark, f"{root}/versions")


def publish(df: DataFrame, root: str, read_at: int | None = None, **facts) -> dict:
    """Writes df as the next version of the table at root; readers see it all at once, or not at all.

    The rows go to a new folder first, with Spark's own commit of task outputs; then one small document, created
    exclusively, names that folder. A failed run leaves the published version as it was. If another writer has published since
    the version ``read_at`` (by default the one at the start), this one fails with ConcurrentUpdate. The version
    before stays for those who still read it; older ones are deleted. ``facts`` are kept in the document.
    """
    spark, doc = df.sparkSession, _published(df.sparkSession, root)
    version, now = doc.load()
    if read_at is not None and version != read_at:
        raise ConcurrentUpdate(root)
    folder = f"{root}/data/v{version + 1:06d}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    new = {**facts, "version": version + 1, "folder": folder, "before": now and now["folder"]}
    if not doc.commit(version, new):
        delete(spark, folder)
        raise ConcurrentUpdate(root)
    if now and now["before"]:
        delete(spark, now["before"])
    return new


def published_as(spark: SparkSession, root: str) -> dict | None:
    """The document of the published version."""
    return _published(spark, root).load()[1]


def published(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The published version of the table at root, or None."""
    now = published_as(spark, root)
    if now is None:
        return None
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(now["folder"])
