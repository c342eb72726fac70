"""The binary files of a log segment and of a sorted run, record by record, without Spark.

All integers are big-endian. The layouts are fixed by the file formats:

log record     total length u32 | crc32 u32 | term u64 | index u64 | type u8 | key length u16 | key | value
run entry      key length u16 | key | value length u32 | value | tombstone u8 | timestamp i64
run index      key length u16 | key | offset u64, for every 16th entry
run footer     index offset, index length, filter offset, filter length, entry count u64 | min and max key, each u16 + bytes |
               footer length u32 | magic u32
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import batched
from typing import BinaryIO

from mergestone.config import BLOOM_RATE, MAX_KEY_BYTES, SPARSE_EVERY
from mergestone.errors import CorruptFile, KeyTooLong

#: Fixed value: the last four bytes of a run.
RUN_MAGIC = 0x53535401

#: Bytes of a read, and of the read at a run's end.
READ_BYTES = 4 << 20
TAIL_BYTES = 64 << 10

_HEAD = struct.Struct(">II")
_BODY = struct.Struct(">qqBH")
_U16, _U32, _U64, _I64 = struct.Struct(">H"), struct.Struct(">I"), struct.Struct(">Q"), struct.Struct(">q")
_FOOT = struct.Struct(">QQQQQ")
_FILTER = struct.Struct(">QI")


# ---------------------------------------------------------------- log segments
def encode_log_record(term: int, index: int, kind: int, key: bytes, value: bytes | None) -> bytes:
    if len(key) > MAX_KEY_BYTES:
        raise KeyTooLong(f"{len(key)} bytes")
    payload = _BODY.pack(term, index, kind, len(key)) + key + (value or b"")
    return _HEAD.pack(len(payload) + 4, zlib.crc32(payload)) + payload


@dataclass
class LogBlock:
    """Consecutive records of a segment, by column: NumPy arrays of numbers, lists of bytes."""

    offset: object
    term: object
    index: object
    kind: object
    keys: list[bytes]
    values: list[bytes]


def read_log_blocks(stream: BinaryIO, block: int = READ_BYTES) -> Iterator[LogBlock]:
    """The records of a segment up to the first damaged one, read some megabytes at a time.

    A length that is too small or reaches beyond the file, a short read, a wrong checksum or a key longer than its
    record ends the segment without an error. A missing value comes back as an empty one.
    """
    import numpy as np

    size = stream.seek(0, 2)
    stream.seek(0)
    base, buf, more, damaged = 0, b"", block, False
    while not damaged:
        data = stream.read(more)
        buf, more = buf + data, block
        view, at, starts, ends, sizes = memoryview(buf), 0, [], [], []
        while at + _HEAD.size <= len(buf):
            total, crc = _HEAD.unpack_from(buf, at)
            end = at + 4 + total
            if total < _BODY.size + 4 or base + end > size:
                damaged = True
                break
            if end > len(buf):
                more = max(block, end - len(buf))
                break
            n = _U16.unpack_from(buf, at + 25)[0]
            if zlib.crc32(view[at + 8 : end]) != crc or _BODY.size + n > total - 4:
                damaged = True
                break
            starts.append(at)
            ends.append(end)
            sizes.append(n)
            at = end
        if starts:
            places = np.array(starts, dtype=np.int64)
            fixed = np.frombuffer(buf, dtype=np.uint8)[places[:, None] + np.arange(8, 25)]
            numbers = np.ascontiguousarray(fixed[:, :16]).view(">i8").astype(np.int64)
            keys = [buf[a + 27 : a + 27 + n] for a, n in zip(starts, sizes)]
            values = [buf[a + 27 + n : z] for a, z, n in zip(starts, ends, sizes)]
            yield LogBlock(places + base, numbers[:, 0], numbers[:, 1], fixed[:, 16].astype(np.int8), keys, values)
        if not data:
            return
        base, buf = base + at, buf[at:]


def read_log(stream: BinaryIO) -> Iterator[tuple]:
    """(offset, term, index, type, key, value) of the same records."""
    for b in read_log_blocks(stream):
        yield from zip(b.offset.tolist(), b.term.tolist(), b.index.tolist(), b.kind.tolist(), b.keys, b.values)


# ---------------------------------------------------------------- sorted runs
def encode_entry(key: bytes, value: bytes | None, tombstone: bool, ts: int) -> bytes:
    if len(key) > MAX_KEY_BYTES:
        raise KeyTooLong(f"{len(key)} bytes")
    value = value or b""
    return b"".join((_U16.pack(len(key)), key, _U32.pack(len(value)), value, b"\1" if tombstone else b"\0", _I64.pack(ts)))


class KeyFilter:
    """A Bloom filter over byte keys, of textbook size; its bytes are this engine's own. Whole lists of keys are taken at a time."""

    def __init__(self, bits: int, hashes: int, data: bytearray | None = None) -> None:
        self.bits, self.hashes = max(8, bits), max(1, hashes)
        self.data = data if data is not None else bytearray((self.bits + 7) // 8)

    @classmethod
    def sized(cls, keys: int, rate: float = BLOOM_RATE) -> KeyFilter:
        from mergestone.operators.bloom import optimal_bits, optimal_hashes

        return cls(optimal_bits(max(1, keys), rate), optimal_hashes(max(1, keys), rate))

    @staticmethod
    def hash(keys: Iterable[bytes]):
        """Two 64-bit numbers for each key, as a NumPy array of two columns."""
        import numpy as np
        import xxhash

        pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
        pairs[:, 0] |= np.uint64(1)
        return pairs

    def _places(self, hashes) -> Iterator:
        """For each hash function the byte and the bit of all keys."""
        import numpy as np

        for i in range(self.hashes):
            p = (hashes[:, 1] + np.uint64(i) * hashes[:, 0]) % np.uint64(self.bits)
            yield (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)

    def add_hashes(self, hashes) -> None:
        import numpy as np

        data = np.frombuffer(self.data, dtype=np.uint8)
        for byte, bit in self._places(hashes):
            np.bitwise_or.at(data, byte, bit)

    def may_contain_hashes(self, hashes):
        import numpy as np

        data, found = np.frombuffer(self.data, dtype=np.uint8), np.ones(len(hashes), dtype=bool)
        for byte, bit in self._places(hashes):
            found &= (data[byte] & bit) != 0
        return found

    def add(self, *keys: bytes) -> None:
        self.add_hashes(self.hash(keys))

    def may_contain(self, key: bytes) -> bool:
        return bool(self.may_contain_hashes(self.hash([key]))[0])

    def serialize(self) -> bytes:
        return _FILTER.pack(self.bits, self.hashes) + bytes(self.data)

    @classmethod
    def deserialize(cls, data: bytes) -> KeyFilter:
        if len(data) < _FILTER.size:
            raise CorruptFile("a filter without a head")
        bits, hashes = _FILTER.unpack_from(data)
        if len(data) != _FILTER.size + (bits + 7) // 8:
            raise CorruptFile("a filter of another size than it says")
        return cls(bits, hashes, bytearray(data[_FILTER.size :]))


class RunWriter:
    """Writes a run to a stream, some entries at a time; of what is written it keeps the hashes of the keys and the sparse index."""

    def __init__(self, stream: BinaryIO, rate: float = BLOOM_RATE) -> None:
        self.stream, self.rate, self.index, self.hashes = stream, rate, [], []
        self.at, self.n, self.first, self.last = 0, 0, None, None

    def write(self, keys: list[bytes], values: Iterable[bytes | None], tombstones: Iterable[bool], times: Iterable[int]) -> None:
        """Entries as columns; keys must rise strictly, also over calls."""
        out = []
        for key, value, tombstone, ts in zip(keys, values, tombstones, times):
            if self.last is not None and key <= self.last:
                raise ValueError("keys must rise")
            if self.n % SPARSE_EVERY == 0:
                self.index.append((key, self.at))
            data = encode_entry(key, value, tombstone, ts)
            out.append(data)
            self.last, self.n, self.at = key, self.n + 1, self.at + len(data)
        if keys:
            self.first = keys[0] if self.first is None else self.first
            self.hashes.append(KeyFilter.hash(keys))
            self.stream.write(b"".join(out))

    def finish(self) -> dict:
        """Writes index, filter and footer; returns the run's metadata."""
        found = KeyFilter.sized(self.n, self.rate)
        for h in self.hashes:
            found.add_hashes(h)
        at, sparse, bloom = self.at, b"".join(_U16.pack(len(k)) + k + _U64.pack(o) for k, o in self.index), found.serialize()
        foot = _FOOT.pack(at, len(sparse), at + len(sparse), len(bloom), self.n) + b"".join(_U16.pack(len(k)) + k for k in (self.first or b"", self.last or b""))
        self.stream.write(sparse + bloom + foot + _U32.pack(len(foot)) + _U32.pack(RUN_MAGIC))
        return {"entry_count": self.n, "min_key": self.first, "max_key": self.last, "index_offset": at, "index_len": len(sparse), "bloom_offset": at + len(sparse), "bloom_len": len(bloom)}


def write_run(stream: BinaryIO, entries: Iterable[tuple[bytes, bytes | None, bool, int]], rate: float = BLOOM_RATE) -> dict:
    """Writes (key, value, tombstone, ts) rows, which must rise strictly by key; returns the run's metadata."""
    out = RunWriter(stream, rate)
    for part in batched(entries, 4_096):
        out.write(*map(list, zip(*part)))
    return out.finish()


@dataclass
class RunBlock:
    """Consecutive entries of a run, by column."""

    keys: list[bytes]
    values: list[bytes]
    tombstone: object
    ts: object

    def __getitem__(self, some: slice) -> RunBlock:
        return RunBlock(self.keys[some], self.values[some], self.tombstone[some], self.ts[some])


def _run_block(data: bytes) -> RunBlock:
    import numpy as np

    keys, values, tails, at = [], [], [], 0
    while at < len(data):
        k = at + 2 + _U16.unpack_from(data, at)[0]
        v = k + 4 + _U32.unpack_from(data, k)[0]
        keys.append(data[at + 2 : k])
        values.append(data[k + 4 : v])
        tails.append(v)
        at = v + 9
    fixed = np.frombuffer(data, dtype=np.uint8)[np.array(tails, dtype=np.int64)[:, None] + np.arange(9)] if tails else np.zeros((0, 9), np.uint8)
    return RunBlock(keys, values, fixed[:, 0] == 1, np.ascontiguousarray(fixed[:, 1:]).view(">i8").astype(np.int64).ravel())


class RunReader:
    """A run in a seekable stream: metadata, filter, sparse index, point lookup and scan. Index and filter are read when they are needed."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream = stream
        size = stream.seek(0, 2)
        if size < 8:
            raise CorruptFile("too short for a run")
        # one read gets the footer and, of a small run, the rest too
        self._tail_at = max(0, size - TAIL_BYTES)
        stream.seek(self._tail_at)
        self._tail = stream.read(size - self._tail_at)
        n, magic = struct.unpack(">II", self._tail[-8:])
        if magic != RUN_MAGIC or n + 8 > size or n < _FOOT.size + 4:
            raise CorruptFile("no run")
        foot = self._read(size - 8 - n, size - 8)
        self.index_offset, self._index_len, self._bloom_offset, self._bloom_len, self.entry_count = _FOOT.unpack_from(foot)
        at, keys = _FOOT.size, []
        for _ in range(2):
            (k,) = _U16.unpack_from(foot, at)
            keys.append(foot[at + 2 : at + 2 + k])
            at += 2 + k
        self.min_key, self.max_key = keys if self.entry_count else (None, None)

    def _read(self, begin: int, end: int) -> bytes:
        if begin >= self._tail_at:
            return self._tail[begin - self._tail_at : end - self._tail_at]
        self.stream.seek(begin)
        return self.stream.read(end - begin)

    @cached_property
    def index(self) -> tuple[list[bytes], list[int]]:
        """Keys and places of every 16th entry."""
        raw, keys, places, at = self._read(self.index_offset, self.index_offset + self._index_len), [], [], 0
        while at < len(raw):
            (k,) = _U16.unpack_from(raw, at)
            keys.append(raw[at + 2 : at + 2 + k])
            places.append(_U64.unpack_from(raw, at + 2 + k)[0])
            at += 10 + k
        return keys, places

    @cached_property
    def filter(self) -> KeyFilter:
        return KeyFilter.deserialize(self._read(self._bloom_offset, self._bloom_offset + self._bloom_len))

    def blocks(self, low: bytes | None = None, high: bytes | None = None, most: int = READ_BYTES) -> Iterator[RunBlock]:
        """The entries with keys in [low, high], read some megabytes at a time; a missing bound is open."""
        if not self.entry_count or low is not None and low > self.max_key or high is not None and high < self.min_key:
            return
        keys, places = self.index
        first = max(0, bisect_right(keys, low) - 1) if low is not None else 0
        last = bisect_right(keys, high) if high is not None else len(keys)
        ends = [*places[1:], self.index_offset]
        while first < last:
            stop = max(first + 1, bisect_right(places, places[first] + most, first, last))
            block = _run_block(self._read(places[first], ends[stop - 1]))
            a = bisect_left(block.keys, low) if low is not None else 0
            z = bisect_right(block.keys, high) if high is not None else len(block.keys)
            if a < z:
                yield block[a:z]
            first = stop

    def scan(self) -> Iterator[tuple]:
        """(key, value, tombstone, ts) in key order."""
        for b in self.blocks():
            yield from zip(b.keys, b.values, b.tombstone.tolist(), b.ts.tolist())

    def get_many(self, wanted: Iterable[bytes]) -> Iterator[RunBlock]:
        """The entries of the wanted keys, tombstones too: key range, filter, sparse index, then one block of at most 16 entries each."""
        inside = sorted(k for k in set(wanted) if self.entry_count and self.min_key <= k <= self.max_key)
        if not inside:
            return
        may = self.filter.may_contain_hashes(KeyFilter.hash(inside))
        keys, places = self.index
        ends, read = [*places[1:], self.index_offset], None
        for key in (k for k, m in zip(inside, may) if m):
            i = bisect_right(keys, key) - 1
            if i != read:
                block, read = _run_block(self._read(places[i], ends[i])), i
            at = bisect_left(block.keys, key)
            if at < len(block.keys) and block.keys[at] == key:
                yield block[at : at + 1]

    def get(self, key: bytes) -> tuple | None:
        for b in self.get_many([key]):
            return b.keys[0], b.values[0], bool(b.tombstone[0]), int(b.ts[0])
        return None
