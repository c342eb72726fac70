"""Far too many small files: indexed archive containers (problem 2).

The records of many small runs are packed, as bytes, into large blocks. A block belongs to one store and
level and has an index of its members: path, offset, length, checksum and counts. Any member can be read
from its block alone, so reading is parallel over blocks and a lookup opens one.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergestone.session import materialize

#: A block is closed when it has so many bytes; a written file gets about FILE_BYTES of blocks, more where the files would be too many.
BLOCK_BYTES = 8 << 20
FILE_BYTES = 256 << 20
MOST_FILES = 100_000

MEMBER = T.StructType(
    [
        T.StructField("sst_path", T.StringType()), T.StructField("sst_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("crc32", T.LongType()), T.StructField("versions", T.LongType()), T.StructField("stored", T.LongType()),
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("store_id", T.IntegerType()), T.StructField("sst_level", T.LongType()), T.StructField("block", T.StringType()), T.StructField("records", T.LongType()),
        T.StructField("members", T.ArrayType(MEMBER)), T.StructField("payload", T.BinaryType()),
    ]
)

_U32 = struct.Struct(">I")
_NUMBER = r"(?is)(?:^|[/\\])[\s\p{Z}]*([0-9]+)\.sst[\s\p{Z}]*$"
_LEVEL = r"(?is)(?:^|[/\\])l([0-9]+)[/\\][^/\\]*$"


def file_number(path: Column) -> Column:
    """The number of the run a path names, however the path is written; null if its end is not <number>.sst."""
    return F.regexp_extract(path, _NUMBER, 1).try_cast("long")


def file_level(path: Column) -> Column:
    """The level in a path L<level>/<number>.sst; null without one."""
    return F.regexp_extract(path, _LEVEL, 1).try_cast("long")


def _be(n: Column, width: int) -> Column:
    """Big-endian two's complement in ``width`` bytes; null is 0."""
    return F.unhex(F.right(F.lpad(F.hex(F.coalesce(n.cast("long"), F.lit(0))), 16, "0"), F.lit(2 * width)))


def encode_record() -> Column:
    """A version as bytes: flags u8 | ts i64 | log index i64 | key length u32 | key | value length u32 | value."""
    flags = F.lit(0)
    for bit, c in enumerate(("key_bytes", "value_bytes", "tombstone", "ts", "log_index")):
        flags = flags + F.when(F.col(c).isNull(), 1 << bit).otherwise(0)
    flags = flags + F.when(F.col("tombstone"), 1 << 5).otherwise(0)
    key, value = (F.coalesce(F.col(c), F.lit(b"")) for c in ("key_bytes", "value_bytes"))
    return F.concat(_be(flags, 1), _be(F.col("ts"), 8), _be(F.col("log_index"), 8), _be(F.octet_length(key), 4), key, _be(F.octet_length(value), 4), value)


def decode_records(data: bytes) -> list:
    """The records in ``data`` as Arrow columns key_bytes, value_bytes, tombstone, ts, log_index; the inverse of encode_record."""
    import numpy as np
    import pyarrow as pa

    starts, keys, values, at = [], [], [], 0
    while at < len(data):
        k = at + 21 + _U32.unpack_from(data, at + 17)[0]
        v = k + 4 + _U32.unpack_from(data, k)[0]
        starts.append(at)
        keys.append(data[at + 21 : k])
        values.append(data[k + 4 : v])
        at = v
    fixed = np.frombuffer(data, dtype=np.uint8)[np.array(starts, dtype=np.int64)[:, None] + np.arange(17)]
    flags, numbers = fixed[:, 0], np.ascontiguousarray(fixed[:, 1:]).view(">i8").astype(np.int64)
    columns = ((keys, pa.binary()), (values, pa.binary()), (flags >> 5 & 1 == 1, pa.bool_()), (numbers[:, 0], pa.int64()), (numbers[:, 1], pa.int64()))
    return [pa.array(c, t, mask=flags >> bit & 1 == 1) for bit, (c, t) in enumerate(columns)]


def listed_versions(sst_info: DataFrame, sst_entry: DataFrame) -> DataFrame:
    """The versions of listed files, once for each file that has them: the columns of sst_entry, sst_id, sst_level and ``owner``.

    A file is listed if any path of sst_info names its number. Rows read twice are one version; should copies
    of (file, key, ts) differ, that of the greatest log_index counts. A version (store, key, ts) in several
    files has one ``owner``, the file of the deepest level and, within it, of the greatest number. Null keys
    and times are values of their own; rows whose own path has no number belong to no listed file.
    """
    listed = sst_info.select(file_number(F.col("sst_path")).alias("sst_id")).where(F.col("sst_id").isNotNull()).distinct()
    rows = sst_entry.select(
        "store_id", "key_bytes", "ts", "sst_path", file_number(F.col("sst_path")).alias("sst_id"), file_level(F.col("sst_path")).alias("sst_level"),
        F.struct("log_index", "tombstone", "value_bytes").alias("v"),
    )
    versions = rows.join(listed, "sst_id", "left_semi").groupBy("store_id", "key_bytes", "ts", "sst_level", "sst_id").agg(F.max("v").alias("v"), F.min("sst_path").alias("sst_path"))
    first = F.row_number().over(Window.partitionBy("store_id", "key_bytes", "ts").orderBy(F.col("sst_level").desc(), F.col("sst_id").desc()))
    return versions.select("store_id", "sst_level", "sst_id", "sst_path", "key_bytes", "ts", "v.*", (first == 1).alias("owner"))


def _packer(block_bytes: int):
    """Streams records in order into blocks. The bytes of a batch lie side by side in Arrow's buffer, so members are slices of it."""

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(BLOCK)
        part, n_blocks = TaskContext.get().partitionId(), 0
        home, chunks, members, size = None, [], [], 0

        def close():
            nonlocal chunks, members, size, n_blocks
            row = {"store_id": home[0], "sst_level": home[1], "block": f"{part:06d}-{n_blocks:06d}", "records": sum(m["stored"] for m in members), "members": members, "payload": b"".join(chunks)}
            n_blocks, chunks, members, size = n_blocks + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            t = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            stores, levels, ids = (t[c].to_pylist() for c in ("store_id", "sst_level", "sst_id"))
            paths, data = t["sst_path"], t["record"]
            lengths = np.asarray(pc.binary_length(data))
            ends = np.cumsum(lengths)
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1] or stores[i] != stores[i - 1] or levels[i] != levels[i - 1]), len(ids)]
            raw = b"".join(data.to_pylist())
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                while a < z:
                    if home != (stores[a], levels[a]) or size >= block_bytes:
                        if members:
                            yield close()
                        home = (stores[a], levels[a])
                    begin = int(ends[a] - lengths[a])
                    stop = min(z, max(a + 1, int(np.searchsorted(ends, begin + block_bytes - size, side="left")) + 1))
                    piece = raw[begin : int(ends[stop - 1])]
                    last = members[-1] if members else None
                    if last and last["sst_id"] == ids[a]:
                        last["crc32"] = zlib.crc32(piece, last["crc32"])
                    else:
                        last = {"sst_path": paths[a].as_py(), "sst_id": ids[a], "offset": size, "length": 0, "crc32": zlib.crc32(piece), "versions": 0, "stored": 0}
                        members.append(last)
                    last["length"] += len(piece)
                    last["versions"] += stop - a
                    last["stored"] += int((lengths[a:stop] > 0).sum())
                    chunks.append(piece)
                    size += len(piece)
                    a = stop
        if members:
            yield close()

    return pack


def pack_archive(sst_info: DataFrame, sst_entry: DataFrame, block_bytes: int = BLOCK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Packs the records of all listed files into blocks (schema BLOCK) and writes them to the shared folder; returns the table.

    Each version (store, key, ts) is stored once, in the block of its owner; in other files that have it, it counts
    in ``versions`` but not in ``stored``. Records are range-partitioned by store, level, file, key and time, so a store that
    holds a third of all rows, or one huge file, is spread over as many tasks as its bytes need; a file that crosses a
    block's end has a member in each block. The number of written files follows from the bytes, not the input's files.
    """
    order = ["store_id", "sst_level", "sst_id", "key_bytes", "ts"]
    size = sst_entry.agg(F.sum(F.coalesce(F.octet_length("key_bytes"), F.lit(0)) + F.coalesce(F.octet_length("value_bytes"), F.lit(0)) + 25).alias("b")).first()["b"] or 0
    record = F.when(F.col("owner"), encode_record()).otherwise(F.lit(b""))
    rows = listed_versions(sst_info, sst_entry).select(*order, "sst_path", record.alias("record"))
    laid = rows.repartitionByRange(max(1, min(MOST_FILES, math.ceil(size / file_bytes))), *order).sortWithinPartitions(*order)
    return materialize(laid.select("store_id", "sst_level", "sst_id", "sst_path", "record").mapInArrow(_packer(block_bytes), BLOCK), "archive")


def archive_index(archive: DataFrame) -> DataFrame:
    """One row for each member: store_id, sst_level, block and the fields of MEMBER. Payloads are not read."""
    return archive.select("store_id", "sst_level", "block", F.explode("members").alias("m")).select("store_id", "sst_level", "block", "m.*")


def archived_files(archive: DataFrame) -> DataFrame:
    """One row for each file: its distinct (key, ts) and how many of them its members store."""
    return archive_index(archive).groupBy("sst_level", "sst_id").agg(F.sum("versions").alias("versions"), F.sum("stored").alias("stored"), F.count(F.lit(1)).alias("members"))


def unpack_archive(archive: DataFrame, where: Column | None = None) -> DataFrame:
    """The stored records of all members (or of those in ``where``, a condition on archive_index columns), checksums verified.

    A member whose bytes don't match its checksum fails the task. Blocks are read in parallel, members independently.
    """
    if where is not None:
        wanted = archive_index(archive).where(where).groupBy("block").agg(F.collect_list(F.struct(*MEMBER.names)).alias("members"))
        archive = archive.drop("members").join(wanted, "block")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["store_id", "sst_level", "sst_id", "sst_path", "key_bytes", "value_bytes", "tombstone", "ts", "log_index"]
        for b in batches:
            for store, level, members, payload in zip(*(b.column(c).to_pylist() for c in ("store_id", "sst_level", "members", "payload"))):
                for m in members:
                    data = payload[m["offset"] : m["offset"] + m["length"]]
                    if zlib.crc32(data) != m["crc32"]:
                        raise ValueError(f"checksum of {m['sst_path']} doesn't match")
                    if not data:
                        continue
                    columns = decode_records(data)
                    same = zip((store, level, m["sst_id"], m["sst_path"]), (pa.int32(), pa.int64(), pa.int64(), pa.string()))
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(columns[0]), t) for x, t in same), *columns], names=names)

    def joined(batches: Iterator) -> Iterator:
        """Members are small; their rows go on in batches of some thousands."""
        import pyarrow as pa

        held, n = [], 0
        for b in read(batches):
            held.append(b)
            n += b.num_rows
            if n >= 8_192:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    schema = "store_id int, sst_level long, sst_id long, sst_path string, key_bytes binary, value_bytes binary, tombstone boolean, ts long, log_index long"
    return archive.select("store_id", "sst_level", "members", "payload").mapInArrow(joined, schema)


def small_files(archive: DataFrame, fewer_than: int = 64) -> DataFrame:
    """(sst_level, sst_id) of the packed files with fewer than so many distinct (key, ts), from the archive's index."""
    return archived_files(archive).where(F.col("versions") < fewer_than).select("sst_level", "sst_id")
