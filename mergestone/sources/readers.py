"""Python data sources for the binary files: ``wal`` and ``sst``, read and written in parallel, a file a task.

    spark.dataSource.register(WalSource); spark.read.format("wal").load(folder)
    df.write.format("sst").mode("append").save(folder)

Paths are local paths or URIs of any file system that Arrow knows; they must be visible to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

WAL_SCHEMA = "path string, segment int, offset long, term long, log_index long, op_type tinyint, key_bytes binary, value_bytes binary"
SST_SCHEMA = "path string, key_bytes binary, value_bytes binary, tombstone boolean, ts long"


def open_fs(path: str):
    """(file system, path in it) of a local path or URI; Hadoop's file:/ form is a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


#: A task reads files of so many bytes together, or so many files; a larger file is a task of its own.
PART_BYTES, PART_FILES = 16 << 20, 256


def list_files(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, by path; none if it is missing."""
    from pyarrow import fs

    where, inner = open_fs(folder)
    found = where.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


@dataclass
class FilePart(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    paths: list


class _FileReader(DataSourceReader):
    suffix = ""

    def __init__(self, options) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[FilePart]:
        parts, held = [], 0
        for path, size in list_files(self.folder, self.suffix):
            if not parts or held + size > PART_BYTES or len(parts[-1].paths) >= PART_FILES:
                parts.append(FilePart([]))
                held = 0
            parts[-1].paths.append(path)
            held += size
        return parts

    def read(self, partition: FilePart) -> Iterator:
        """Arrow batches of some megabytes."""
        if not isinstance(partition, FilePart):  # an empty list of parts becomes one without files
            return
        where, _ = open_fs(self.folder)
        for path in partition.paths:
            with where.open_input_file(path) as f:
                yield from self._batches(path, f)


def _batch(schema, columns: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _wal_schema():
    import pyarrow as pa

    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.binary())
    return pa.schema(list(zip((c.split()[0] for c in WAL_SCHEMA.split(", ")), kinds)))


def _sst_schema():
    import pyarrow as pa

    return pa.schema([("path", pa.string()), ("key_bytes", pa.binary()), ("value_bytes", pa.binary()), ("tombstone", pa.bool_()), ("ts", pa.int64())])


class _WalReader(_FileReader):
    suffix = ".log"

    def _batches(self, path: str, f) -> Iterator:
        import re

        from mergestone.sources.formats import read_log_blocks

        number, schema = re.search(r"wal-(\d+)\.log$", path), _wal_schema()
        for b in read_log_blocks(f):
            n = len(b.keys)
            yield _batch(schema, [[path] * n, [int(number[1]) if number else None] * n, b.offset, b.term, b.index, b.kind, b.keys, b.values])


class _SstReader(_FileReader):
    """Conditions on the key are taken over: a run outside them isn't read beyond its footer, and wanted keys are looked up."""

    suffix = ".sst"

    def __init__(self, options) -> None:
        super().__init__(options)
        self.keys: set | None = None
        self.low: bytes | None = None
        self.high: bytes | None = None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)) or f.attribute != ("key_bytes",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                keys = {bytes(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.keys = keys if self.keys is None else self.keys & keys
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low or b"", bytes(f.value))
                if isinstance(f, GreaterThan):
                    yield f  # the bound itself is left to Spark
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = bytes(f.value) if self.high is None else min(self.high, bytes(f.value))
                if isinstance(f, LessThan):
                    yield f

    def _batches(self, path: str, f) -> Iterator:
        from mergestone.sources.formats import RunReader

        run, schema = RunReader(f), _sst_schema()
        if self.keys is None:
            blocks = run.blocks(self.low, self.high)
        else:
            blocks = run.get_many(k for k in self.keys if (self.low is None or k >= self.low) and (self.high is None or k <= self.high))
        for b in blocks:
            yield _batch(schema, [[path] * len(b.keys), b.keys, b.values, b.tombstone, b.ts])


class _FileWriter(DataSourceArrowWriter):
    """Each task writes its files under a temporary name; they get their names when all tasks have succeeded."""

    def __init__(self, options) -> None:
        self.folder = options["path"]

    def _place(self, batch) -> list:
        """The file of each row."""
        raise NotImplementedError

    def _start(self, stream):
        """(write(batch), finish()) for a new file."""
        raise NotImplementedError

    def write(self, iterator) -> Written:
        import uuid

        where, inner = open_fs(self.folder)
        done, current, stream, put, finish = [], None, None, None, None

        def close() -> None:
            if stream is not None:
                finish()
                stream.close()

        for batch in iterator:
            names = self._place(batch)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if names[a] != current:
                    close()
                    current, final = names[a], f"{inner.rstrip('/')}/{names[a]}"
                    part = f"{final}.{uuid.uuid4().hex}.part"
                    where.create_dir(final.rpartition("/")[0], recursive=True)
                    stream = where.open_output_stream(part)
                    done.append((part, final))
                    put, finish = self._start(stream)
                put(batch.slice(a, z - a))
        close()
        return Written(done)

    def commit(self, messages) -> None:
        where, _ = open_fs(self.folder)
        for m in messages:
            for part, final in m.paths if m else []:
                where.move(part, final)

    def abort(self, messages) -> None:
        where, _ = open_fs(self.folder)
        for m in messages:
            for part, _ in m.paths if m else []:
                where.delete_file(part)


class _WalWriter(_FileWriter):
    def _place(self, batch) -> list:
        folders = batch.column("folder").to_pylist() if "folder" in batch.schema.names else [""] * batch.num_rows
        return [f"{f}/wal-{n:06d}.log" if f else f"wal-{n:06d}.log" for f, n in zip(folders, batch.column("segment").to_pylist())]

    def _start(self, stream):
        from mergestone.sources.formats import encode_log_record

        def put(batch) -> None:
            columns = (batch.column(c).to_pylist() for c in ("term", "log_index", "op_type", "key_bytes", "value_bytes"))
            stream.write(b"".join(map(encode_log_record, *columns)))

        return put, lambda: None


class _SstWriter(_FileWriter):
    def _place(self, batch) -> list:
        return batch.column("file").to_pylist()

    def _start(self, stream):
        from mergestone.sources.formats import RunWriter

        run = RunWriter(stream)
        return lambda batch: run.write(*(batch.column(c).to_pylist() for c in ("key_bytes", "value_bytes", "tombstone", "ts"))), run.finish


class WalSource(DataSource):
    """Log segments ``wal-<number>.log``. Reading stops a segment at its first damaged record.

    Writing takes segment, term, log_index, op_type, key_bytes, value_bytes and optionally ``folder``, partitioned so that a
    segment is in one task, in the order its records shall have.
    """

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return WAL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WalReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _WalWriter(self.options)


class SstSource(DataSource):
    """Sorted runs ``*.sst``. Writing takes ``file`` (a name such as L0/000001.sst), key_bytes, value_bytes, tombstone and ts, a file
    in one task, keys rising and unique within it."""

    @classmethod
    def name(cls) -> str:
        return "sst"

    def schema(self) -> str:
        return SST_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SstReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SstWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets conditions on keys go down to the runs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WalSource, SstSource):
        spark.dataSource.register(source)
