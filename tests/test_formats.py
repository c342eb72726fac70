"""The binary files: round trips, damage, filters, point lookups; and the sources over them."""

import io
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergestone.errors import ConcurrentUpdate, CorruptFile, KeyTooLong
from mergestone.functions import layout
from mergestone.operators import log
from mergestone.sources.formats import KeyFilter, RunReader, encode_log_record, read_log, write_run
from mergestone.sources.manifest import Manifest
from mergestone.sources.readers import register

RECORDS = st.lists(st.tuples(st.integers(0, 2**62), st.integers(0, 2**62), st.sampled_from([1, 2]), st.binary(max_size=40), st.binary(max_size=60)), max_size=20)


def log_bytes(records):
    return b"".join(encode_log_record(*r) for r in records)


@settings(max_examples=60, deadline=None)
@given(RECORDS)
def test_log_round_trip(records):
    got = list(read_log(io.BytesIO(log_bytes(records))))
    assert [g[1:] for g in got] == records
    assert all(len(encode_log_record(*r)) == 27 + len(r[3]) + len(r[4]) for r in records)


@settings(max_examples=60, deadline=None)
@given(RECORDS.filter(bool), st.data())
def test_damage_ends_a_segment(records, data):
    raw = bytearray(log_bytes(records))
    at = data.draw(st.integers(0, len(raw) - 1))
    raw[at] ^= 0x5A
    sizes = [27 + len(r[3]) + len(r[4]) for r in records]
    whole = next(i for i in range(len(records)) if at < sum(sizes[: i + 1]))
    assert [g[1:] for g in read_log(io.BytesIO(raw))][:whole] == records[:whole]
    assert len(list(read_log(io.BytesIO(raw)))) <= len(records)


def test_torn_tail_and_tiny_length():
    good = [(0, i, 1, b"key-%03d" % i, b"v") for i in range(50)]
    for tail in (bytes.fromhex("000003E8FFFFFFFFAB"), b"\0\0\0\1\0\0\0\0", b"\xff\xff\xff\xff\0\0\0\0" + b"x" * 99, b"\0"):
        assert len(list(read_log(io.BytesIO(log_bytes(good) + tail)))) == 50
    with pytest.raises(KeyTooLong):
        encode_log_record(0, 0, 1, b"k" * 65_536, b"")


def run_of(entries):
    out = io.BytesIO()
    meta = write_run(out, entries)
    return RunReader(io.BytesIO(out.getvalue())), meta


def test_run_round_trip_and_lookup():
    entries = [(b"key-%06d" % i, b"" if i % 2 else b"value-%06d" % i, i % 2 == 1, i) for i in range(1000)]
    run, meta = run_of(entries)
    assert (meta["entry_count"], meta["min_key"], meta["max_key"]) == (1000, b"key-000000", b"key-000999")
    assert list(run.scan()) == entries and len(run.index[0]) == 63
    assert all(run.get(e[0]) == e for e in entries)
    assert [run.get(k) for k in (b"aaa-missing", b"key-000500x", b"key-999999", b"zzz-missing")] == [None] * 4


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.binary(max_size=12), st.tuples(st.binary(max_size=12), st.booleans(), st.integers(-(2**63), 2**63 - 1)), max_size=60))
def test_any_run(entries):
    rows = [(k, *v) for k, v in sorted(entries.items())]
    run, _ = run_of(rows)
    assert list(run.scan()) == rows
    assert all(run.get(r[0]) == r for r in rows)


def test_lookups_and_ranges_of_a_large_run(monkeypatch):
    """Index and filter before what the first read gets, several blocks."""
    from mergestone.sources import formats

    monkeypatch.setattr(formats, "TAIL_BYTES", 2_000)
    rng = random.Random(4)
    entries = [(b"%08d" % (3 * i), rng.randbytes(rng.randrange(40)), i % 5 == 0, i) for i in range(9_000)]
    run, _ = run_of(entries)
    assert run._tail_at > run.index_offset
    assert [k for b in run.blocks(most=5_000) for k in b.keys] == [e[0] for e in entries]
    wanted = [b"%08d" % rng.randrange(30_000) for _ in range(500)] + [b"", b"\xff"]
    found = {b.keys[0]: (b.values[0], bool(b.tombstone[0]), int(b.ts[0])) for b in run.get_many(wanted)}
    assert found == {k: (v, t, ts) for k, v, t, ts in entries if k in set(wanted)}
    for low, high in ((b"%08d" % 100, b"%08d" % 9_000), (None, b"%08d" % 6), (b"%08d" % 26_990, None), (b"%08d" % 7, b"%08d" % 8), (b"9", None), (None, b"")):
        got = [k for b in run.blocks(low, high, most=20_000) for k in b.keys]
        assert got == [k for k, *_ in entries if (low is None or k >= low) and (high is None or k <= high)]


def test_records_larger_than_a_read_and_lengths_beyond_the_file():
    from mergestone.sources.formats import read_log_blocks

    rng = random.Random(5)
    records = [(1, i, 1, b"k%d" % i, rng.randbytes(rng.choice([0, 5, 700, 5_000]))) for i in range(200)]
    raw = log_bytes(records)
    for block in (64, 1_000, 1 << 20):
        blocks = list(read_log_blocks(io.BytesIO(raw), block))
        assert [r for b in blocks for r in zip(b.index.tolist(), b.keys, b.values)] == [(i, k, v) for _, i, _, k, v in records]
        assert [int(o) for b in blocks for o in b.offset][:2] == [0, len(encode_log_record(*records[0]))]
    cut = raw + (1 << 31).to_bytes(4, "big") + b"\0" * 50
    assert len(list(read_log(io.BytesIO(cut)))) == 200


def test_bad_runs():
    with pytest.raises(ValueError):
        run_of([(b"b", b"", False, 0), (b"a", b"", False, 0)])
    for raw in (b"", b"x" * 40):
        with pytest.raises(CorruptFile):
            RunReader(io.BytesIO(raw))


def test_filter_rate_and_bytes():
    f = KeyFilter.sized(10_000)
    for i in range(10_000):
        f.add(b"exists-%06d" % i)
    f = KeyFilter.deserialize(f.serialize())
    assert all(f.may_contain(b"exists-%06d" % i) for i in range(10_000))
    assert sum(f.may_contain(b"missing-%06d" % i) for i in range(10_000)) < 200
    with pytest.raises(CorruptFile):
        KeyFilter.deserialize(f.serialize() + b"x")


def test_column_layout_agrees_with_the_format(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2**40), i, 1 + i % 2, rng.randbytes(i % 7), rng.randbytes(i % 5) if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "term long, log_index long, op_type tinyint, key_bytes binary, value_bytes binary")
    for r in log.with_checksum(df).collect():
        raw = encode_log_record(r.term, r.log_index, r.op_type, bytes(r.key_bytes), r.value_bytes and bytes(r.value_bytes))
        assert bytes(r.record) == raw and r.crc32 == zlib.crc32(raw[8:])
    back = df.select("term", layout.unpack_be(layout.pack_be(F.col("term"), 8), 0, 8).alias("b"))
    assert back.where("term <> b").count() == 0
    assert spark.range(1).select(layout.run_name(F.lit(1), F.lit(12))).first()[0] == "L1/000012.sst"


def test_wal_source(spark, tmp_path):
    register(spark)
    rows = [(1 + i // 40, 0, i + 1, 1 + i % 2, b"key-%03d" % i, b"v%d" % i) for i in range(100)]
    df = spark.createDataFrame(rows, "segment int, term long, log_index long, op_type tinyint, key_bytes binary, value_bytes binary")
    df.repartition("segment").sortWithinPartitions("segment", "log_index").write.format("wal").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["wal-000001.log", "wal-000002.log", "wal-000003.log"]
    read = lambda: spark.read.format("wal").load(str(tmp_path))
    assert sorted((r.segment, r.log_index, r.op_type, bytes(r.key_bytes), bytes(r.value_bytes)) for r in read().collect()) == [(s, i, t, k, v) for s, _, i, t, k, v in rows]
    middle = tmp_path / "wal-000002.log"
    raw = bytearray(middle.read_bytes())
    raw[len(raw) // 2] ^= 1  # damage in the middle ends that segment only
    middle.write_bytes(raw)
    got = {s: n for s, n in read().groupBy("segment").count().collect()}
    assert got[1] == 40 and got[3] == 20 and 0 < got[2] < 40
    big = spark.createDataFrame([(9, 0, 1, 1, b"big", bytes(i % 256 for i in range(1 << 20)))], df.schema)
    big.write.format("wal").mode("append").save(str(tmp_path / "big"))
    assert bytes(spark.read.format("wal").load(str(tmp_path / "big")).first().value_bytes) == bytes(i % 256 for i in range(1 << 20))
    (tmp_path / "none").mkdir()
    assert spark.read.format("wal").load(str(tmp_path / "none")).count() == 0


def test_sst_source(spark, tmp_path):
    register(spark)
    rows = [("L0/000001.sst", b"%03d" % i, b"v", i % 3 == 0, i) for i in range(50)] + [("L1/000002.sst", b"a", None, True, 7)]
    df = spark.createDataFrame(rows, "file string, key_bytes binary, value_bytes binary, tombstone boolean, ts long")
    df.repartition("file").sortWithinPartitions("file", "key_bytes").write.format("sst").mode("append").save(str(tmp_path))
    back = spark.read.format("sst").load(str(tmp_path)).collect()
    assert sorted((r.path.split("/")[-1], bytes(r.key_bytes), r.tombstone, r.ts) for r in back) == sorted((f[3:], k, t, ts) for f, k, _, t, ts in rows)


def test_conditions_go_down_to_the_runs(spark, tmp_path):
    register(spark)
    rows = [(f"L0/{f:06d}.sst", b"%05d" % (f * 100 + i), b"v%d" % i, i % 3 == 0, i) for f in range(4) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, key_bytes binary, value_bytes binary, tombstone boolean, ts long")
    df.repartition("file").sortWithinPartitions("file", "key_bytes").write.format("sst").mode("append").save(str(tmp_path))
    read, k = lambda: spark.read.format("sst").load(str(tmp_path)), F.col("key_bytes")
    want = lambda keep: sorted((f[3:], key) for f, key, *_ in rows if keep(key))
    got = lambda df: sorted((r.path.split("/")[-1], bytes(r.key_bytes)) for r in df.collect())
    assert got(read().where(k == F.lit(b"00250"))) == want(lambda x: x == b"00250")
    assert got(read().where(k.isin(b"00005", b"00250", b"9"))) == want(lambda x: x in (b"00005", b"00250"))
    assert got(read().where((k > F.lit(b"00100")) & (k <= F.lit(b"00202")))) == want(lambda x: b"00100" < x <= b"00202")
    assert got(read().where((k >= F.lit(b"00580")) & ~F.col("tombstone"))) == sorted((f[3:], x) for f, x, _, t, _ in rows if x >= b"00580" and not t)
    assert got(read().where((k == F.lit(b"00250")) & (k == F.lit(b"00251")))) == [] and got(read().where(k.isNull())) == []
    # what was taken over isn't checked again by Spark
    plan = read().where(k == F.lit(b"00250"))._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert m.runs == [] and (m.allocate(), m.allocate()) == (1, 2)
    m.add("L0/000001.sst", 0)
    m.add("L0/000002.sst", 0)
    m.swap([{"path": "L1/000003.sst", "level": 1, "min_key": "61"}], ["L0/000001.sst"])
    again = Manifest(spark, str(tmp_path))
    assert [r["path"] for r in again.runs] == ["L0/000002.sst", "L1/000003.sst"] and again.allocate() == 3
    assert again.remove("L0/000002.sst") and not again.remove("L0/000002.sst")
    assert [r.path for r in Manifest(spark, str(tmp_path)).frame().collect()] == ["L1/000003.sst"]
    with pytest.raises(ConcurrentUpdate):
        m.swap([{"path": "L1/000009.sst", "level": 1}], ["L0/000001.sst"])  # gone by another handle
    m.swap([], [], flushed=7)
    with pytest.raises(ConcurrentUpdate):
        again.swap([], [], flushed=7)
    max((tmp_path / "manifest").glob("*.json")).write_text("{")
    with pytest.raises(CorruptFile):
        Manifest(spark, str(tmp_path))
