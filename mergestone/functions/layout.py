"""Column expressions for the storage layout: big-endian numbers, record bytes, sizes, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergestone.config import MEMTABLE_OVERHEAD, RUN_OVERHEAD, WAL_OVERHEAD


def pack_be(n: Column, width: int) -> Column:
    """n as ``width`` bytes, big-endian two's complement. A null is null."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * width)))


def unpack_be(data: Column, at: int, width: int) -> Column:
    """The unsigned number in ``width`` bytes of data from place ``at`` (from 0); eight bytes wrap to a signed long."""
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, -10 if width == 8 else 10).cast("long")


def byte_length(data: Column) -> Column:
    """Bytes of a value; a null has none."""
    return F.coalesce(F.octet_length(data), F.lit(0)).cast("long")


def memtable_bytes(key: Column, value: Column) -> Column:
    return byte_length(key) + byte_length(value) + MEMTABLE_OVERHEAD


def wal_bytes(key: Column, value: Column) -> Column:
    return byte_length(key) + byte_length(value) + WAL_OVERHEAD


def run_bytes(key: Column, value: Column) -> Column:
    return byte_length(key) + byte_length(value) + RUN_OVERHEAD


def wal_payload(term: Column, index: Column, kind: Column, key: Column, value: Column) -> Column:
    """term u64 | index u64 | type u8 | key length u16 | key | value."""
    return F.concat(pack_be(term, 8), pack_be(index, 8), pack_be(kind, 1), pack_be(F.octet_length(key), 2), key, F.coalesce(value, F.lit(b"")))


def wal_record(payload: Column) -> Column:
    """total length u32 | CRC-32 of the payload u32 | payload; the length counts the CRC and the payload."""
    return F.concat(pack_be(F.octet_length(payload) + 4, 4), pack_be(F.crc32(payload), 4), payload)


def run_name(level: Column, number: Column) -> Column:
    return F.format_string("L%d/%06d.sst", level, number)
