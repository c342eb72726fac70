"""The operators of problems 1 to 6 against plain Python, with nulls, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mergestone.operators import archive, change_feed, copy_diff, hot_keys, incremental, offsets, seen_keys
from mergestone.operators.bloom import BlockedBloom, Geometry
from mergestone.session import shared_path
from mergestone.sources import files


def some_bytes(rng, n=6):
    return bytes(rng.randrange(256) for _ in range(rng.randrange(n)))


# ------------------------------------------------------------------------------------ 1
KNOWN, PUTS = "key_bytes binary, at long", "put_id long, key_bytes binary, kind string, block int"


@pytest.mark.parametrize("target", [0.001, 0.5, 0.9])
def test_seen_keys_are_exact_at_any_rate(spark, target):
    rng = random.Random(int(1000 * target))
    keys = [some_bytes(rng) for _ in range(150)] + [b"", b"hot"]
    known = [(rng.choice(keys), 1) for _ in range(80)] + [(None, 1)]
    puts = [(i, rng.choice(keys) if rng.random() < 0.6 else b"hot", "x", 5) for i in range(400)] + [(1000 + i, None, None, None) for i in range(3)]
    rng.shuffle(puts)
    seen, want = {k for k, _ in known if k is not None}, set()
    for i, k, *_ in sorted(puts):
        if k is not None:
            want |= {i} if k in seen else set()
            seen.add(k)
    got = seen_keys.already_seen(spark.createDataFrame(known, KNOWN), spark.createDataFrame(puts, PUTS), "put_id", target=target)
    assert sorted(r["at"] for r in got.collect()) == sorted(want)


def test_seen_keys_on_empty_tables_and_equal_numbers(spark):
    none, puts = spark.createDataFrame([], KNOWN), spark.createDataFrame([(1, b"a", "", 0), (1, b"a", "", 0), (1, b"b", "", 0), (2, b"a", "", 0), (None, b"a", "", 0)], PUTS)
    assert [r["at"] for r in seen_keys.already_seen(none, puts, "put_id").collect()] == [2]
    assert seen_keys.already_seen(none, puts.limit(0), "put_id").collect() == []
    assert seen_keys.error_rate(none, puts.limit(0), "put_id").first()["probes"] == 0


def absent_and_present(spark):
    """40,000 known keys; 30,000 incoming, of them 10,000 known."""
    text = lambda c: F.col(c).cast("string").cast("binary").alias("key_bytes")
    return spark.range(40_000).select(text("id")), spark.range(30_000, 60_000).select(F.col("id").alias("put_id"), text("id"))


@pytest.mark.parametrize("target", [0.01, 0.001])
def test_error_rate_is_near_its_target(spark, target):
    known, puts = absent_and_present(spark)
    r = seen_keys.error_rate(known, puts, "put_id", target=target).first()
    assert (r["probes"], r["new_keys"], r["incoming_keys"], r["known_keys"]) == (30_000, 20_000, 30_000, 40_000)
    slack = 3 * (target / 30_000) ** 0.5
    assert 0.5 * target - slack < r["measured_rate"] < 2 * target + slack
    assert 0 < r["wrong_new_keys"] + 1 < 2 * target * 20_000 + 20
    # the exact check sees the keys that are on both sides and a few more
    assert 10_000 <= r["checked_keys"] == 10_000 + r["wrong_new_keys"] and 10_000 <= r["possible_known"] < 10_000 + 2 * target * 30_000 + 20
    assert r["filter_bytes"] < 60_000 * (3 if target == 0.001 else 2)


def test_without_the_filters_all_keys_would_be_checked(spark, monkeypatch):
    """The filters decide how much work there is, the exact check that the answer is right."""
    known, puts = absent_and_present(spark)
    want = sorted(r["at"] for r in seen_keys.already_seen(known, puts, "put_id").collect())
    always = seen_keys._judge

    def maybe(*geometry):
        judge = always(*geometry)

        def run(batches):
            import numpy as np

            from mergestone.operators import bloom

            bloom.BlockedBloom.contains = lambda self, h1, h2: np.ones(len(h1), dtype=bool)
            bloom.BlockedBloom.query_then_add = lambda self, h1, h2: np.ones(len(h1), dtype=bool)
            import importlib

            try:
                yield from judge(batches)
            finally:
                importlib.reload(bloom)

        return run

    monkeypatch.setattr(seen_keys, "_judge", maybe)
    r = seen_keys.error_rate(known, puts, "put_id").first()
    assert (r["checked_keys"], r["possible_known"], r["wrong_new_keys"]) == (30_000, 40_000, 20_000)
    assert sorted(r["at"] for r in seen_keys.already_seen(known, puts, "put_id").collect()) == want == list(range(30_000, 40_000))


def test_blocked_filter_never_forgets():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, (2, 5000), dtype=np.int64)
    f = BlockedBloom(Geometry.of(5000, 0.01))
    first = f.query_then_add(h[0], h[1])
    assert first.mean() < 0.02 and f.contains(h[0], h[1]).all() and f.query_then_add(h[0], h[1]).all()
    assert BlockedBloom(Geometry.of(0, 0.01)).query_then_add(h[0][[0, 1, 0]], h[1][[0, 1, 0]]).tolist()[2]


# ------------------------------------------------------------------------------------ 2
ENTRY = "sst_path string, store_id int, key_bytes binary, value_bytes binary, tombstone boolean, ts long, log_index long, sst_level int, block string"
INFO = "info_id long, sst_path string, sst_level int"


def test_paths(spark):
    good = ["store-0001/L0/000007.sst", "STORE-1/L0/000007.SST", "a\\L0\\7.sst", "./x//L0/7.sst \t", "file:///v/L0/0000000007.Sst", "L0/../L0/7.sst", "7.sst"]
    bad = ["x/7.sst.bak", "x/7.sst~", "x/a7.sst", "x/.sst", "", None, "x/7 .sst", "x/99999999999999999999.sst"]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string").select(archive.file_number(F.col("p")).alias("n"), archive.file_level(F.col("p")).alias("l"))
    rows = df.collect()
    assert [r.n for r in rows] == [7] * len(good) + [None] * len(bad)
    assert [r.l for r in rows[:7]] == [0] * 6 + [None]


@pytest.mark.parametrize("block_bytes,file_bytes", [(1, 300), (100, 1000), (1 << 20, 1 << 20)])
def test_archive_round_trip(spark, block_bytes, file_bytes):
    rng = random.Random(block_bytes)
    entries = []
    for _ in range(400):
        n = rng.randrange(1, 9)
        entries.append((f"store-1/L{n % 3}/{n:06d}.sst", n % 2, some_bytes(rng, 3), rng.choice([None, b"", some_bytes(rng)]), rng.choice([True, False, None]), rng.choice([None, -1, rng.randrange(3)]), rng.choice([None, rng.randrange(99)]), 5, "b"))
    entries += entries[:50] + [("odd", 1, b"k", b"v", False, 1, 1, 0, "")]
    info = [(i, f"x\\{n}.SST ", 9) for i, n in enumerate([1, 2, 3, 4, 5, 6, 6, 77])] + [(9, None, None), (10, "x/7.sst.tmp", 0)]
    packed = archive.pack_archive(spark.createDataFrame(info, INFO), spark.createDataFrame(entries, ENTRY), block_bytes, file_bytes)
    files_of, best = defaultdict(set), {}
    none = lambda x: (x is not None, x if x is not None else 0)
    for path, store, key, value, tomb, ts, index, *_ in entries:
        if path != "odd" and int(path[-10:-4]) <= 6:
            n = int(path[-10:-4])
            files_of[(store, key, ts)].add((n % 3, n))
            at = (store, key, ts, n)
            rank = (none(index), none(tomb), (value is not None, value or b""))
            if at not in best or rank > best[at][0]:
                best[at] = (rank, value, tomb, index)
    want = []
    for (store, key, ts), fs in files_of.items():
        level, n = max(fs)
        _, value, tomb, index = best[(store, key, ts, n)]
        want.append((store, level, n, key, value, tomb, ts, index))
    got = [(r.store_id, r.sst_level, r.sst_id, bytes(r.key_bytes), None if r.value_bytes is None else bytes(r.value_bytes), r.tombstone, r.ts, r.log_index) for r in archive.unpack_archive(packed).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    counts = Counter(f for fs in files_of.values() for f in fs)
    assert {(r.sst_level, r.sst_id): r.versions for r in archive.archived_files(packed).collect()} == counts
    assert {(r.sst_level, r.sst_id) for r in archive.small_files(packed, 20).collect()} == {f for f, n in counts.items() if n < 20}
    homes = packed.select("store_id", "sst_level", "records", F.size("members").alias("m"), F.octet_length("payload").alias("n")).collect()
    assert all(r.m for r in homes) and sum(r.records for r in homes) == len(want)
    one = archive.unpack_archive(packed, F.col("sst_id") == 3)
    assert one.count() == sum(w[2] == 3 for w in want)


def test_archive_of_nothing_and_damage(spark):
    info, entries = spark.createDataFrame([], INFO), spark.createDataFrame([], ENTRY)
    assert archive.unpack_archive(archive.pack_archive(info, entries)).count() == 0
    info = spark.createDataFrame([(1, "L0/1.sst", 0)], INFO)
    entries = spark.createDataFrame([("L0/000001.sst", 1, b"k" * 70_000, b"v" * 200_000, False, 1, 1, 0, "")], ENTRY)
    packed = archive.pack_archive(info, entries)
    assert archive.unpack_archive(packed).count() == 1
    broken = packed.withColumn("payload", F.expr("overlay(payload placing x'00' from 100)"))
    with pytest.raises(Exception, match="checksum"):
        archive.unpack_archive(broken).count()


# ------------------------------------------------------------------------------------ 3
def test_global_offsets(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.randrange(5)) for i in range(300)]
    got = offsets.global_offsets(spark.createDataFrame(rows, "k string, i int, n long"), ["k", "i"], partitions=5).collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.k is not None, r.k or "", r.i)):
        assert r.start == total
        total += r.n
    assert len(got) == 300
    assert offsets.global_offsets(spark.createDataFrame([], "k string, n long"), ["k"]).collect() == []


@pytest.mark.parametrize("chunk", [1, 7, 100, 10**6])
def test_per_key_totals(spark, chunk, tmp_path):
    rng = random.Random(chunk)
    pick = lambda: rng.choice([b"hot", b"hot", b"hot", b"", b"\0", b"warm", some_bytes(rng, 3), None])
    wal = [(pick(), rng.choice([1, 2, 0, None]), rng.choice([None, b"", some_bytes(rng)]), "s", 3) for _ in range(500)]
    put = [(pick(), rng.choice([True, False, None]), rng.choice([None, b"xy"])) for _ in range(300)]
    w = spark.createDataFrame(wal, "key_bytes binary, op_type tinyint, value_bytes binary, split string, place int")
    p = spark.createDataFrame(put, "key_bytes binary, tombstone boolean, value_bytes binary")
    w.repartition(3).write.parquet(str(tmp_path / "w"))
    totals, counts = hot_keys.per_key(spark.read.parquet(str(tmp_path / "w")), p, chunk)
    want = {}
    for name, rows in (("wal_entry", wal), ("kvpair_put", put)):
        for key in {r[0] for r in rows} - {None}:
            mine = [r for r in rows if r[0] == key]
            is_put, is_delete = ((1, 2) if name == "wal_entry" else (False, True))
            flags = [r[1] for r in mine]
            count = lambda x: sum(f is x if isinstance(x, bool) else f == x for f in flags)  # noqa: E731, B023
            want[(name, key)] = (len(mine), count(is_put), count(is_delete), sum(len(r[2] or b"") for r in mine))
    assert {(r.table_name, bytes(r.key_bytes)): (r.rows, r.puts, r.deletes, r.value_bytes) for r in totals.collect()} == want
    assert counts.agg(F.sum("n")).first()[0] == 800
    hot = hot_keys.hot_keys(spark.read.parquet(str(tmp_path / "w")), p, 0.1, chunk)
    assert {(r.table_name, bytes(r.key_bytes)) for r in hot.collect()} == {k for k, v in want.items() if v[0] >= 0.1 * (500 if k[0] == "wal_entry" else 300)}


def test_per_key_of_nothing(spark):
    w = spark.createDataFrame([], "key_bytes binary, op_type tinyint, value_bytes binary")
    p = spark.createDataFrame([(None, True, None)], "key_bytes binary, tombstone boolean, value_bytes binary")
    assert hot_keys.per_key(w, p)[0].collect() == [] and hot_keys.hot_keys(w, p).collect() == []


# ------------------------------------------------------------------------------------ 4
PAIR = "store_id int, key_bytes binary, value_bytes binary, tombstone boolean, ts long, term long, log_index long, sign int, field string"


def test_differences(spark):
    p = [
        (1, b"same", b"v", False, 1, 1, 5), (1, b"same", b"v", False, 2, 1, 5), (1, b"old", b"v", False, 1, 1, 5), (1, b"old", b"x", True, 1, 9, 4), (1, b"alone", None, None, None, None, None),
        (1, b"", b"a", True, 0, None, 1), (1, b"empty", None, False, 0, 1, 1), (1, b"null", b"v", None, 0, None, 1), (2, b"same", b"v", False, 1, 1, 1), (None, b"x", b"", True, 1, 1, 1), (1, None, b"", True, 1, 1, 1),
    ]
    r = [
        (1, b"same", b"v", False, 9, 1, 6), (1, b"old", b"v", False, 1, 1, 7), (1, b"", b"b", False, 0, 3, 1), (1, b"empty", b"", False, 0, 1, 1), (1, b"null", b"v", False, 0, None, 1), (2, b"Same", b"v", False, 1, 1, 1),
    ]
    frame = lambda rows: spark.createDataFrame([(*x, 7, "row") for x in rows], PAIR)
    got = copy_diff.diff_copies(frame(p), frame(r)).collect()
    assert sorted((x.store_id, bytes(x.key_bytes), x["diff"]) for x in got) == sorted(
        [(1, b"alone", "only_primary"), (1, b"", "value"), (1, b"", "term"), (1, b"", "tombstone"), (1, b"null", "tombstone"), (2, b"same", "only_primary"), (2, b"Same", "only_replica")]
    )
    assert {x["diff"] for x in copy_diff.diff_copies(frame(p), frame([])).collect()} == {"only_primary"}
    assert copy_diff.diff_copies(frame([]), frame([])).collect() == []
    assert copy_diff.diff_copies(frame(p), frame(p)).collect() == []


# ------------------------------------------------------------------------------------ 5
CHANGE = "store_id int, key_bytes binary, value_bytes binary, deleted boolean, seq long, h string"


def state_rows(state):
    return {(r.store_id, bytes(r.key_bytes)): (r.seq, r.deleted, None if r.value_bytes is None else bytes(r.value_bytes)) for r in state.collect()}


@pytest.mark.parametrize("bucket_bytes,calls", [(1, 1), (300, 4), (10**6, 3)])
def test_changes_in_any_order_over_any_calls(spark, bucket_bytes, calls):
    rng = random.Random(bucket_bytes)
    changes = [(rng.randrange(3), rng.choice([b"hot", b"", some_bytes(rng, 2)]), rng.choice([None, b"", some_bytes(rng)]), rng.random() < 0.4, i, "x") for i in range(600)]
    want = {}
    for s, k, v, d, i, _ in changes:
        want[(s, k)] = (i, d, v)
    dirty = changes + rng.sample(changes, 200) + [(None, b"a", b"", False, 1, ""), (1, None, b"", False, 1, ""), (1, b"zz", b"", False, None, "")]
    rng.shuffle(dirty)
    root = shared_path(spark, "state-test")
    for call in range(calls):
        state = change_feed.apply_changes(spark.createDataFrame(dirty[call::calls], CHANGE), root, bucket_bytes=bucket_bytes)
    assert state_rows(state) == want
    assert change_feed.live(state).count() == sum(not d for _, d, _ in want.values())
    again = change_feed.apply_changes(spark.createDataFrame([(9, b"n", b"v", None, 1, ""), (9, b"n", b"w", True, 1, ""), (9, b"n", b"x", False, 1, "")], CHANGE), root)
    assert state_rows(again) == {**want, (9, b"n"): (1, True, b"w")}
    assert files.published_as(spark, root)["version"] == calls + 1


def test_late_puts_find_the_stored_delete(spark):
    root, change = shared_path(spark, "state-test"), lambda *rows: spark.createDataFrame([(1, *r, "") for r in rows], CHANGE)
    change_feed.apply_changes(change((b"a", b"1", False, 1), (b"a", None, True, 5), (b"b", b"2", False, 2)), root)
    state = change_feed.apply_changes(change((b"a", b"3", False, 3)), root, base=change((b"b", b"9", False, 1), (b"c", b"0", False, 1)).drop("h"))
    assert state_rows(state) == {(1, b"a"): (5, True, None), (1, b"b"): (2, False, b"2"), (1, b"c"): (1, False, b"0")}
    # equal numbers: a delete wins over what is stored, then the greater value
    state = change_feed.apply_changes(change((b"b", b"1", False, 2), (b"c", b"1", False, 1)), root)
    assert state_rows(state)[(1, b"b")] == (2, False, b"2") and state_rows(state)[(1, b"c")] == (1, False, b"1")
    state = change_feed.apply_changes(change((b"b", None, True, 2)), root)
    assert state_rows(state)[(1, b"b")] == (2, True, None)
    assert state_rows(change_feed.apply_changes(change(), root)) == state_rows(state)


def test_large_values_fit_small_memory(spark):
    n, root = 20_000, shared_path(spark, "state-test")
    big = lambda seq: spark.range(n).select(F.lit(1).alias("store_id"), F.col("id").cast("string").cast("binary").alias("key_bytes"), F.repeat(F.lit("v"), 4_000).cast("binary").alias("value_bytes"), F.lit(False).alias("deleted"), F.lit(seq).cast("long").alias("seq"))
    for seq in (2, 1):
        state = change_feed.apply_changes(big(seq), root, bucket_bytes=4 << 20, memory=64 << 20)
    got = state.agg(F.count(F.lit(1)), F.min("seq"), F.sum(F.octet_length("value_bytes"))).first()
    assert tuple(got) == (n, 2, n * 4_000)


def test_two_publishers_lose_nothing(spark):
    from mergestone.errors import ConcurrentUpdate

    root, frame = shared_path(spark, "publish-test"), spark.range(3)
    assert files.publish(frame, root)["version"] == 1
    with pytest.raises(ConcurrentUpdate):
        files.publish(frame, root, read_at=0)
    assert files.publish(frame.limit(1), root, read_at=1)["version"] == 2 and files.published(spark, root).count() == 1


def test_versions_of_a_document(spark):
    from concurrent.futures import ThreadPoolExecutor

    doc = files.Document(spark, shared_path(spark, "document-test"))
    assert doc.load() == (0, None)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: doc.update(lambda now: {"n": (now or {"n": 0})["n"] + 1}), range(24)))
    assert doc.load() == (24, {"n": 24}) and len(doc.versions()) <= doc.KEEP + 1
    assert not doc.commit(23, {}) and not doc.commit(3, {}) and doc.load()[0] == 24


def test_no_changes(spark):
    assert change_feed.apply_changes(spark.createDataFrame([], CHANGE), shared_path(spark, "state-test")).collect() == []


# ------------------------------------------------------------------------------------ 6
WAL = "store_id int, segment int, term long, log_index long, op_type tinyint, key_bytes binary, value_bytes binary, arrived_at timestamp, early int"
META = "store_id int, save_seq int, truncated_before long, saved_at timestamp, committed boolean"


def stamp(minute):
    import datetime

    return datetime.datetime(2024, 1, 1, 0, minute)


def record(store, index, term=1, kind=1, key=b"k", minute=0):
    return (store, 1, term, index, kind, key, b"v", stamp(minute), 0)


def write(spark, rows, path):
    spark.createDataFrame(rows, WAL).coalesce(1).write.mode("append").parquet(path)


def due(spark, log, meta):
    return sorted((r.store_id, r.log_index, r.term) for r in incremental.due_records(log.records(), spark.createDataFrame(meta, META)).collect())


def fresh_log(spark):
    return incremental.IncrementalLog(spark, shared_path(spark, "incremental-test"))


def test_runs_take_in_each_file_once_and_survive_failures(spark, tmp_path):
    source, root = str(tmp_path / "in"), shared_path(spark, "incremental-test")
    log = incremental.IncrementalLog(spark, root)
    write(spark, [record(1, i) for i in range(1, 11)], source)
    with pytest.raises(RuntimeError):
        log.run(source, fail_before_commit=True)
    assert log.batches() == [] and log.records().collect() == []
    first = log.run(source)
    assert len(first) == 1 and log.run(source) == [] and log.records().count() == 10
    assert len(files.children(spark, f"{root}/data")) == 1  # what the failed attempt wrote is gone
    write(spark, [record(1, 10), record(1, 10, term=5), record(1, 11), record(2, 1, term=None), record(2, 2, kind=0), record(2, 3, key=None)], source)
    second = incremental.IncrementalLog(spark, root).run(source)
    assert len(second) == 1 and log.batches() == first + second
    want = [*[(1, i, 1) for i in range(1, 10)], (1, 10, 5), (1, 11, 1), (2, 1, 0)]
    assert due(spark, log, []) == want
    assert sorted((r.store_id, r.log_index) for r in log.added(1).collect()) == [(1, 10), (1, 11), (2, 1)]
    fresh = fresh_log(spark)
    assert len(fresh.run(source, batch_files=1)) in (1, 2) and fresh.run(source) == []
    assert due(spark, fresh, []) == want
    log.merge()
    assert len(log.batches()) == 1 and due(spark, log, []) == want and log.run(source) == []
    (tmp_path / "none").mkdir()
    assert fresh_log(spark).run(str(tmp_path / "none")) == []


def one_file(spark, rows, path):
    """Writes rows as the one file at path, over what is there."""
    import shutil

    spark.createDataFrame(rows, WAL).coalesce(1).write.mode("overwrite").parquet(f"{path}-folder")
    path.parent.mkdir(exist_ok=True)
    (part,) = path.parent.parent.glob(f"{path.parent.name}/{path.name}-folder/*.parquet")
    shutil.move(part, path)
    shutil.rmtree(f"{path}-folder")


def test_rewritten_and_removed_files(spark, tmp_path):
    import os

    source, log = tmp_path / "in", fresh_log(spark)
    one_file(spark, [record(1, 1, term=9, key=b"zzz"), record(1, 2, key=b"gone")], source / "a.parquet")
    one_file(spark, [record(1, 1, term=2, key=b"low"), record(1, 3)], source / "b.parquet")
    state = lambda: sorted((r.log_index, bytes(r.key_bytes)) for r in log.records().collect())
    log.run(str(source))
    assert state() == [(1, b"zzz"), (2, b"gone"), (3, b"k")]
    one_file(spark, [record(1, 5, key=b"new")], source / "a.parquet")
    assert len(log.run(str(source))) == 1
    # what the older self of the file had hidden is back
    assert state() == [(1, b"low"), (3, b"k"), (5, b"new")]
    assert sorted(r.log_index for r in log.added(1).collect()) == [1, 5]
    os.utime(source / "a.parquet", (1, 1))  # another time, the same bytes: noted, but its records stay as they are
    assert len(log.run(str(source))) == 1 and log.run(str(source)) == [] and state() == [(1, b"low"), (3, b"k"), (5, b"new")]
    assert log.added(2).collect() == []
    log.merge()
    (source / "b.parquet").unlink()
    assert log.run(str(source)) == [] and len(state()) == 3
    assert len(log.run(str(source), follow_removals=True)) == 1 and state() == [(5, b"new")]
    assert log.run(str(source), follow_removals=True) == []
    one_file(spark, [record(1, 1, term=2, key=b"low"), record(1, 3)], source / "b.parquet")
    log.run(str(source))
    assert state() == [(1, b"low"), (3, b"k"), (5, b"new")]
    # bytes changed behind an unchanged size and time are seen by a full check only
    times = (source / "b.parquet").stat().st_mtime_ns
    raw = (source / "b.parquet").read_bytes()
    one_file(spark, [record(1, 1, term=2, key=b"LOW"), record(1, 3)], source / "b.parquet")
    if len((source / "b.parquet").read_bytes()) == len(raw):
        os.utime(source / "b.parquet", ns=(times, times))
        assert log.run(str(source)) == []
        assert len(log.run(str(source), full_check=True)) == 1 and state()[0] == (1, b"LOW")
    assert log.run(str(source), full_check=True) == []


def test_two_runs_at_once(spark, tmp_path):
    from mergestone.errors import ConcurrentUpdate

    source, log = str(tmp_path / "in"), fresh_log(spark)
    write(spark, [record(1, 1)], source)
    slow = incremental.IncrementalLog(spark, log.root)
    wait = slow._write_batch

    def overtaken(*args):
        entry = wait(*args)
        log.run(source)
        return entry

    slow._write_batch = overtaken
    with pytest.raises(ConcurrentUpdate):
        slow.run(source)
    assert len(log.batches()) == 1 and log.records().count() == 1


def test_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    part = tmp_path / "in" / "part-0.parquet"
    part.write_bytes(b"abc" * 500_000)
    listed = incremental.with_checksums(incremental.list_files(spark, str(tmp_path / "in"))).first()
    assert (listed["size"], listed["checksum"]) == (1_500_000, hashlib.md5(b"abc" * 500_000).hexdigest())


def test_a_cluster_needs_a_shared_folder():
    from mergestone.errors import NoSharedFolder
    from mergestone.session import shared_root

    class Fake:
        def __init__(self, master, root=None):
            self.sparkContext, self.conf, self.master, self.root = self, self, master, root

        def get(self, name, default):
            return self.root or default

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(NoSharedFolder):
            shared_root(Fake(master))
        assert shared_root(Fake(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_release_deletes_what_was_written(spark, tmp_path):
    from mergestone import session

    kept, session._written[:] = session._written[:], []
    table = session.materialize(spark.range(3), "release-test")
    path = session._written[0]
    assert table.count() == 3 and files.exists(spark, path)
    session.release(spark)
    assert not files.exists(spark, path) and session._written == []
    session._written[:] = kept


def test_intermediate_tables_go_with_the_application(tmp_path):
    import subprocess
    import sys
    import time

    code = f"""
from mergestone.session import build_session, materialize
spark = build_session("local[1]", 1, spark__ui__enabled="false", spark__checkpoint__dir="file://{tmp_path}/shared")
assert materialize(spark.range(5), "x").count() == 5
import os
assert os.listdir("{tmp_path}/shared/mergestone") == [spark.sparkContext.applicationId]
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    deadline = time.time() + 60
    while list((tmp_path / "shared" / "mergestone").iterdir()) and time.time() < deadline:
        time.sleep(0.5)  # the JVM ends after the interpreter
    assert list((tmp_path / "shared" / "mergestone").iterdir()) == []


def test_marks(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, [record(s, i, minute=i) for s in (1, 2, 3) for i in range(1, 6)] + [record(1, 2, minute=50), record(1, 1, minute=59), record(1, 1, term=9, minute=58)], source)
    log = incremental.IncrementalLog(spark, shared_path(spark, "incremental-test"))
    log.run(source)
    meta = [
        (1, 1, 4, stamp(30), True), (1, 2, 3, stamp(30), True), (1, 2, 3, stamp(30), True), (1, 3, 5, stamp(31), False), (1, 4, None, stamp(31), True), (1, 5, 5, stamp(31), None),
        (2, 1, 9, stamp(2), True), (3, 1, 9, stamp(2), False), (None, 1, 9, stamp(2), True),
    ]
    # store 1: above 3, and the record of index 1 whose greatest term arrived late; the early copy of index 2 counts
    assert due(spark, log, meta) == [(1, 1, 9), (1, 4, 1), (1, 5, 1), (2, 3, 1), (2, 4, 1), (2, 5, 1), *[(3, i, 1) for i in range(1, 6)]]
