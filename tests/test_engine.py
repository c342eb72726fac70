"""The engine over flushes, deletes, compaction, restart and damage."""

import pytest

from mergestone.config import StorageConfig
from mergestone.engine import Engine
from mergestone.errors import EngineClosed, KeyTooLong
from mergestone.sources import files

OPS = "at int, key_bytes binary, value_bytes binary, delete boolean"


def config(path, limit=1 << 20, segment=64 << 20):
    return StorageConfig(str(path), f"{path}/wal", f"{path}/sst", memtable_bytes=limit, wal_segment_bytes=segment)


def batch(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], OPS)


def key(i):
    return b"key-%06d" % i


def value(i):
    return b"value-%06d" % i


def state(engine):
    return {bytes(r.key_bytes): bytes(r.value_bytes or b"") for r in engine.full_snapshot().collect()}


def test_reads_through_flushes_and_deletes(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.apply(batch(spark, [(key(i), value(i), False) for i in range(100)]), "at")
    assert e.flush() == "L0/000001.sst"
    e.apply(batch(spark, [(key(i), None, True) for i in range(0, 100, 2)]), "at")
    assert e.get(key(0)) is None and e.get(key(1)) == value(1) and e.get(b"missing") is None
    assert {bytes(r.key_bytes) for r in e.snapshot().collect()} == set()
    e.flush()
    assert state(e) == {key(i): value(i) for i in range(1, 100, 2)}
    wanted = spark.createDataFrame([(key(0),), (key(1),), (b"",), (key(1),)], "key_bytes binary")
    assert {bytes(r.key_bytes): (r.found, r.value_bytes and bytes(r.value_bytes)) for r in e.multi_get(wanted).collect()} == {key(0): (False, None), key(1): (True, value(1)), b"": (False, None)}


def test_full_memtable_is_flushed_and_four_runs_are_compacted(spark, tmp_path):
    e = Engine(spark, config(tmp_path, limit=2_000))
    for k in range(5):
        e.apply(batch(spark, [(key(i), b"%d-%d" % (k, i), False) for i in range(k, k + 40)]), "at")
    assert len(e.manifest.level(0)) == 1 and len(e.manifest.level(1)) == 1
    assert files.children(spark, f"{tmp_path}/sst/L0") == ["000006.sst"]
    assert state(e) == {key(i): b"%d-%d" % (min(i, 4), i) for i in range(44)}


def test_one_key_over_many_versions(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.apply(batch(spark, [(b"counter", b"version-%d" % i, False) for i in range(50)]), "at")
    assert e.get(b"counter") == b"version-49"
    e.put(b"counter", None)
    assert e.get(b"counter") == b""
    e.delete(b"counter")
    e.put(b"counter", b"again")
    assert e.get(b"counter") == b"again" and e.memtable().count() == 1
    assert e.next_index == 54


def test_restart(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.apply(batch(spark, [(key(i), value(i), False) for i in range(100)]), "at")
    e.flush()
    e.apply(batch(spark, [(key(i), value(i), False) for i in range(100, 120)]), "at")
    e.close()
    again = Engine(spark, config(tmp_path))
    assert state(again) == {key(i): value(i) for i in range(120)}
    assert again.next_index == 121 and again.truncated_before == 100


def test_index_goes_on_when_all_is_truncated(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.put(b"a", b"1")
    e.flush()
    again = Engine(spark, config(tmp_path))
    again.put(b"a", b"2")
    assert again.next_index == 3 and Engine(spark, config(tmp_path)).get(b"a") == b"2"


def test_lost_run_is_skipped_and_stays_cataloged(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.put(b"a", b"1")
    path = e.flush()
    files.delete(spark, f"{tmp_path}/sst/{path}")
    assert e.get(b"a") is None and [r["path"] for r in e.manifest.runs] == [path]


def test_closed(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.close()
    e.close()
    for call in (lambda: e.get(b"a"), lambda: e.put(b"a", b""), lambda: e.delete(b"a"), e.flush, e.snapshot):
        with pytest.raises(EngineClosed):
            call()


def test_empty_and_bad_batches(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    assert e.apply(batch(spark, []), "at") == 0
    assert e.flush() is None and e.compact() is None and state(e) == {}
    for bad in (None, b"x" * 65_536):
        with pytest.raises(KeyTooLong):
            e.apply(batch(spark, [(bad, b"", False)]), "at")
    e.apply(batch(spark, [(b"", b"empty", False), (b"\0", b"zero", False), (b"x" * 65_535, b"long", None)]), "at")
    assert state(e) == {b"": b"empty", b"\0": b"zero", b"x" * 65_535: b"long"}


def test_ten_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(w):
        e = Engine(spark, config(tmp_path))
        for half in range(2):
            e.apply(batch(spark, [(b"g%d-key-%03d" % (w, i), b"g%d-val-%03d" % (w, i), False) for i in range(50 * half, 50 * half + 50)]), "at")
        return e.segment

    with ThreadPoolExecutor(10) as pool:
        segments = list(pool.map(write, range(10)))
    assert len(set(segments)) == 10
    e = Engine(spark, config(tmp_path))
    rows = e.log().collect()
    assert sorted(r.log_index for r in rows) == list(range(1, 1001)) and e.next_index == 1001
    assert {bytes(r.key_bytes): bytes(r.value_bytes) for r in rows} == {b"g%d-key-%03d" % (w, i): b"g%d-val-%03d" % (w, i) for w in range(10) for i in range(100)}
    # a batch's records stay together and in their order
    by_index = {r.log_index: bytes(r.key_bytes) for r in rows}
    assert all(by_index[i][:8] == by_index[i + 1][:8] for i in range(1, 1000) if i % 50)


def test_two_handles(spark, tmp_path):
    one, two = Engine(spark, config(tmp_path)), Engine(spark, config(tmp_path))
    assert one.put(b"a", b"1") == 1 and two.put(b"a", b"2") == 2 and one.put(b"b", b"3") == 3
    assert one.get(b"a") == b"2" and two.get(b"b") == b"3"
    assert two.flush() and one.get(b"a") == b"2" and one.flush() is None
    one.delete(b"a")
    assert two.get(b"a") is None and state(two) == {b"b": b"3"}


def test_a_slower_flush_is_dropped(spark, tmp_path):
    one, two = Engine(spark, config(tmp_path)), Engine(spark, config(tmp_path))
    one.put(b"a", b"1")
    write = one._write_run

    def overtaken(*args):
        run = write(*args)
        two.put(b"a", b"2")
        two.flush()
        return run

    one._write_run = overtaken
    assert one.flush() is None
    assert [r["path"] for r in one.manifest.runs] == ["L0/000002.sst"] and one.get(b"a") == b"2" and one.truncated_before == 2


def test_segments_are_rotated_and_cleared(spark, tmp_path):
    e = Engine(spark, config(tmp_path, segment=100))
    for i in range(4):
        e.put(b"k%d" % i, b"v" * 30)  # 59 bytes each: two fill a segment
    assert [(s["segment"], s["records"], s["first"], s["last"], s["bytes"]) for s in e.segments()] == [(1, 2, 1, 2, 118), (2, 2, 3, 4, 118)]
    again = Engine(spark, config(tmp_path, segment=100))
    assert again.segment == 4  # the third was opened when the second was full
    again.flush()
    assert again.segments() == [] and again.memtable().count() == 0
    again.put(b"z", b"")
    again.flush()
    kept = [n for n in files.children(spark, f"{tmp_path}/wal") if n.startswith("batch=")]
    assert len(kept) == 1 and again.next_index == 6 and state(again).keys() == {b"k0", b"k1", b"k2", b"k3", b"z"}


def test_binary_log_out_and_in(spark, tmp_path):
    e = Engine(spark, config(tmp_path / "a", segment=500))
    e.apply(batch(spark, [(key(i % 30), value(i), i % 7 == 0) for i in range(100)]), "at")
    e.export_log(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("wal-*.log"))) >= 7
    back = Engine(spark, config(tmp_path / "b"))
    assert back.import_log(str(tmp_path / "out")) == 100
    assert state(back) == state(e)


def test_compaction_of_any_level(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    for i in range(3):
        e.apply(batch(spark, [(key(j), b"%d" % i, False) for j in range(i * 5, i * 5 + 10)] + [(b"gone", None, True)]), "at")
        e.flush()
    assert e.compact(at_least=4) is None
    assert e.compact() == "L1/000004.sst" and e.compact(1) == "L2/000005.sst"
    assert [(r["path"], r["level"], r["entry_count"]) for r in e.manifest.runs] == [("L2/000005.sst", 2, 21)]
    assert e.compact(6) is None
    want = {key(j): b"%d" % min(j // 5, 2) for j in range(20)}
    assert state(e) == want
    # a tombstone hides a deeper version, so it stays as long as there may be one
    e.put(b"gone", b"old")
    e.flush()
    e.compact()
    e.delete(b"gone")
    e.flush()
    assert e.compact(drop_tombstones=True) and e.get(b"gone") is None
    assert e.compact(1, drop_tombstones=True) and e.get(b"gone") is None
    assert [(r["level"], r["entry_count"]) for r in e.manifest.runs] == [(2, 20)] and state(e) == want


def test_one_compaction_at_a_time(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.put(b"a", b"1")
    path = e.flush()
    guard = e._guard(0)
    assert guard and e.compact() is None and [r["path"] for r in e.manifest.runs] == [path]
    files.delete(spark, guard)
    write = e._write_run

    def overtaken(*args):
        run = write(*args)
        e.manifest.remove(path)
        return run

    e._write_run = overtaken
    assert e.compact() is None and e.manifest.runs == [] and not files.exists(spark, guard)
    assert files.children(spark, f"{tmp_path}/sst/L1") == []


def test_remove_run(spark, tmp_path):
    e = Engine(spark, config(tmp_path))
    e.put(b"a", b"1")
    path = e.flush()
    assert e.remove_run(path) and not e.remove_run(path)
    assert e.get(b"a") is None and not files.exists(spark, f"{tmp_path}/sst/{path}")


def test_refused_renames_raise(spark, tmp_path):
    from mergestone.errors import ConcurrentUpdate

    for n in ("a", "b"):
        (tmp_path / n).write_text(n)
    with pytest.raises(ConcurrentUpdate):
        files.rename(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(Exception, match="."):
        files.rename(spark, str(tmp_path / "none"), str(tmp_path / "c"))
    assert not files.create_new(spark, str(tmp_path / "b"), b"x") and (tmp_path / "b").read_text() == "b"


def test_exclusive_creation_by_rename(spark, tmp_path, monkeypatch):
    """As on file systems that aren't local."""
    monkeypatch.setattr(files, "_is_local", lambda fs: False)
    path = f"file://{tmp_path}/x/000000000001.json"
    assert files.create_new(spark, path, b"1") and not files.create_new(spark, path, b"2")
    assert files.read_bytes(spark, path) == b"1" and [n for n in files.children(spark, f"{tmp_path}/x") if n.endswith(".part")] == []
    doc = files.Document(spark, f"{tmp_path}/x")
    assert doc.commit(1, {"a": 1}) and not doc.commit(1, {}) and doc.load() == (2, {"a": 1})
