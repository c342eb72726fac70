"""Memtable, log, runs, levels, merge and compaction against hand-made cases and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from mergestone.operators import bloom, compaction, levels, log, memtable, runs, versions

OPS = "store_id int, log_index long, op_type tinyint, key_bytes binary, value_bytes binary"
ENTRIES = "store_id int, level long, run long, key_bytes binary, value_bytes binary, tombstone boolean, ts long, log_index long"


def ops(spark, rows):
    return spark.createDataFrame([(1, i + 1, t, k, v) for i, (t, k, v) in enumerate(rows)], OPS)


def pairs(df, *more):
    return {bytes(r.key_bytes): (None if r.value_bytes is None else bytes(r.value_bytes), *[r[m] for m in more]) for r in df.collect()}


# ------------------------------------------------------------------------------------ memtable
def test_last_write_wins(spark):
    df = memtable.apply_log(ops(spark, [(1, b"name", b"alice"), (1, b"name", b"bob"), (1, b"gone", b"x"), (2, b"gone", b"ignored"), (1, b"a", b"1"), (2, b"a", None), (1, b"a", b"2"), (2, b"never", None), (1, b"nil", None)]))
    assert pairs(df, "tombstone") == {b"name": (b"bob", False), b"gone": (None, True), b"a": (b"2", False), b"never": (None, True), b"nil": (None, False)}
    assert set(pairs(versions.live(df))) == {b"name", b"a", b"nil"}
    assert pairs(memtable.get(df, b"gone")) == {} and pairs(memtable.get(df, b"gone", True), "tombstone") == {b"gone": (None, True)}
    size = memtable.sizes(df).first()
    assert (size.n_keys, size.bytes) == (5, sum(len(k) + len(v or b"") + 41 for k, v in [(b"name", b"bob"), (b"gone", b""), (b"a", b"2"), (b"never", b""), (b"nil", b"")]))


def test_key_order_is_by_bytes(spark):
    keys = [b"date", b"", b"\xff", b"a\0", b"apple", b"a", b"\x7f", b"\0", b"cherry"]
    df = memtable.apply_log(ops(spark, [(1, k, b"val-" + k) for k in keys]))
    assert [bytes(r.key_bytes) for r in memtable.entries_in_order(df).collect()] == sorted(keys)


def fold(rows, limit, memory):
    out, epoch, size, held = [], 1, 0, {}
    for t, k, v in rows:
        if size >= limit:
            epoch, size, held = epoch + 1, 0, {}
        n = len(k) + (len(v or b"") if t == 1 or not memory else 0) + (41 if memory else 27)
        size += n - (held.get(k, 0) if memory else 0)
        held[k] = n
        out.append(epoch)
    return out


@pytest.mark.parametrize("limit", [1, 100, 1024])
def test_epochs(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice([1, 1, 2]), b"k%d" % rng.randrange(12), rng.choice([None, b"", b"v" * rng.randrange(50)])) for _ in range(300)]
    for f, memory in ((memtable.flush_epochs, True), (memtable.rotation, False)):
        got = [r.epoch for r in f(ops(spark, rows), limit).orderBy("log_index").collect()]
        assert got == fold(rows, limit, memory)


def test_memtable_fills_at_the_eighteenth_record(spark):
    rows = [(1, b"key-%05d" % i, b"val-%05d" % i) for i in range(50)]
    epochs = memtable.epoch_summary(memtable.flush_epochs(ops(spark, rows), 1024)).orderBy("epoch").collect()
    assert [(e.first_index, e.last_index) for e in epochs] == [(1, 18), (19, 36), (37, 50)]
    assert memtable.flush_epochs(ops(spark, []), 1024).collect() == []


# ------------------------------------------------------------------------------------ log
WAL = "store_id int, segment int, term long, log_index long, op_type tinyint, key_bytes binary, value_bytes binary"


def test_damage_and_numbers(spark):
    rows = [(1, 1, 1, i, 1, b"k", b"v") for i in range(1, 6)] + [(1, 2, 1, 6, 1, b"k", None), (1, 2, 1, 7, None, b"k", b""), (1, 2, 1, 8, 1, b"k", b""), (1, 3, 1, 9, 1, None, b""), (1, 4, 1, 10, 2, b"k", b""), (2, 1, 1, 1, 3, b"k", b"")]
    df = spark.createDataFrame(rows, WAL)
    assert sorted(r.log_index for r in log.stop_at_damage(df).collect()) == [1, 2, 3, 4, 5, 6, 10]
    assert sorted(tuple(r) for r in log.next_numbers(df).collect()) == [(1, 11, 5), (2, 2, 2)]
    first = log.segments(df).where("store_id = 1 and segment = 1").first()
    assert (first.records, first.first_index, first.last_index, first.bytes) == (5, 1, 5, 5 * 29)
    assert log.stop_at_damage(df.limit(0)).collect() == [] and log.next_numbers(df.limit(0)).collect() == []


# ------------------------------------------------------------------------------------ runs
def entry(level, run, key, value=b"v", ts=1, tomb=False, store=1):
    return (store, level, run, key, value, tomb, ts, ts)


def frame(spark, rows):
    return spark.createDataFrame(rows, ENTRIES)


def test_run_statistics(spark):
    rows = [entry(0, 7, b"key-%06d" % i, b"value-%06d" % i, i) for i in range(1000)]
    df = frame(spark, rows)
    meta = runs.run_meta(df).first()
    assert (meta.entry_count, bytes(meta.min_key), bytes(meta.max_key), meta.data_bytes, meta.tombstones) == (1000, b"key-000000", b"key-000999", 1000 * 37, 0)
    index = runs.sparse_index(df).orderBy("nth").collect()
    assert [(bytes(r.key_bytes), r.offset) for r in index] == [(b"key-%06d" % i, 37 * i) for i in range(0, 1000, 16)]
    m = runs.run_meta(df)
    assert [runs.runs_for_key(m, k).count() for k in (b"aaa", b"key-000500", b"key-000500x", b"zzz")] == [0, 1, 1, 0]
    probe = runs.bloom_probe(df).first()
    assert (probe.keys, probe.rejected) == (1000, 0) and probe.false_positives < 30
    size = runs.bloom_sizes(m).first()
    assert (size.bloom_bits, size.bloom_hashes) == (bloom.optimal_bits(1000, 0.01), bloom.optimal_hashes(1000, 0.01)) == (9586, 7)
    assert runs.bloom_probe(df.limit(0)).collect() == []


def test_run_holds_a_key_once(spark):
    rows = [("s/L0/000001.sst", 1, b"k", b"old", False, 1, 1), ("s/L0/000001.sst", 1, b"k", b"new", None, 2, 2), ("s/L0/000001.sst", 1, b"k", b"new", None, 2, 2), ("s/L2/000002.sst", 1, b"k", None, True, 0, 0)]
    got = runs.run_entries(spark.createDataFrame(rows, "sst_path string, store_id int, key_bytes binary, value_bytes binary, tombstone boolean, ts long, log_index long")).collect()
    assert sorted((r.level, r.run, r.tombstone, r.value_bytes and bytes(r.value_bytes)) for r in got) == [(0, 1, False, b"new"), (2, 2, True, None)]


# ------------------------------------------------------------------------------------ levels
def read(spark, rows):
    df = frame(spark, rows)
    return levels.tiered_get(df, runs.run_meta(df))


def test_level_zero_newest_first_whatever_the_times(spark):
    assert pairs(read(spark, [entry(0, 1, b"a", b"old_value", 900), entry(0, 2, b"a", b"new_value", 200)])) == {b"a": (b"new_value",)}


def test_tombstone_stops_the_search(spark):
    rows = [entry(1, 1, b"name", b"alice", 100), entry(0, 2, b"name", None, 200, True), entry(3, 9, b"deep"), entry(2, 3, b"deep", b"higher", 0)]
    got = read(spark, rows)
    assert pairs(got, "tombstone") == {b"name": (None, True), b"deep": (b"higher", False)}
    assert set(pairs(versions.live(got))) == {b"deep"}


def test_deeper_levels_look_at_one_run(spark):
    rows = [entry(1, 1, b"a"), entry(1, 1, b"f", b"hidden"), entry(1, 2, b"c"), entry(1, 2, b"h"), entry(1, 3, b"h", b"later"), entry(0, 4, b"z")]
    df = frame(spark, rows)
    meta = runs.run_meta(df)
    assert pairs(levels.tiered_get(df, meta), "run") == {b"a": (b"v", 1), b"c": (b"v", 2), b"h": (b"later", 3), b"z": (b"v", 4)}
    wanted = spark.createDataFrame([(1, k) for k in (b"", b"a", b"b", b"c", b"g", b"h", b"i", b"c")] + [(2, b"a")], "store_id int, key_bytes binary")
    got = {(r.store_id, bytes(r.key_bytes)): r.run for r in levels.route(wanted, meta, 1).collect()}
    assert got == {(1, b""): None, (1, b"a"): 1, (1, b"b"): 1, (1, b"c"): 2, (1, b"g"): 2, (1, b"h"): 3, (1, b"i"): None, (2, b"a"): None}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_routes_of_many_keys(spark, partitions):
    rng = random.Random(partitions)
    rows = [entry(1, n, b"%04d" % k, store=s) for s in (1, 2) for n in range(20) for k in {rng.randrange(2000) for _ in range(3)}]
    meta = runs.run_meta(frame(spark, rows))
    wanted = [(s, b"%04d" % rng.randrange(2100)) for s in (1, 2, 3) for _ in range(150)]
    layout = sorted((r.store_id, r.pos, bytes(r.min_key), bytes(r.max_key), r.run) for r in levels.level_layout(meta).collect())
    want = {}
    for s, k in wanted:
        at = [x for x in layout if x[0] == s and x[2] <= k]
        want[(s, k)] = at[-1][4] if at and at[-1][3] >= k else None
    got = levels.route(spark.createDataFrame(wanted, "store_id int, key_bytes binary"), meta, 1, partitions).collect()
    assert {(r.store_id, bytes(r.key_bytes)): r.run for r in got} == want and len(got) == len(want)


def test_memtable_is_the_first_tier(spark):
    df = frame(spark, [entry(0, 1, b"a", b"run"), entry(0, 1, b"b", b"run")])
    memory = memtable.apply_log(ops(spark, [(2, b"a", None), (1, b"c", b"mem")]))
    through = versions.resolve_by_tier(levels.engine_versions(memory, df, runs.run_meta(df)))
    assert pairs(versions.live(through)) == {b"b": (b"run",), b"c": (b"mem",)}


# ------------------------------------------------------------------------------------ merge and compaction
def test_merge_takes_the_newest_and_the_oldest_run_among_equals(spark):
    rows = [entry(0, 1, k, b"old", 100) for k in (b"a", b"c", b"e")] + [entry(0, 2, k, b"new", 200) for k in (b"a", b"b")] + [entry(0, 2, b"c", None, 300, True), entry(0, 3, b"e", b"tie", 100)]
    assert pairs(versions.resolve_by_version(frame(spark, rows)), "tombstone") == {b"a": (b"new", False), b"b": (b"new", False), b"c": (None, True), b"e": (b"old", False)}


def test_the_two_resolutions_differ_where_they_must(spark):
    rows = [entry(0, 1, b"k", b"late clock", 900), entry(0, 2, b"k", b"newest run", 100)]
    assert pairs(read(spark, rows)) == {b"k": (b"newest run",)}
    assert pairs(versions.resolve_by_version(frame(spark, rows))) == {b"k": (b"late clock",)}


def test_compaction(spark):
    rows = [entry(0, r, b"key-%02d" % i, b"%d" % r, r * 100) for r in range(5) for i in range(10, 20)] + [entry(0, 4, b"key-10", None, 900, True)][:0]
    rows += [entry(1, 10, b"key-00"), entry(1, 10, b"key-05"), entry(1, 11, b"key-05x", b"l1"), entry(1, 11, b"key-12", b"stale", 0), entry(1, 12, b"key-19", b"fresh", 999), entry(1, 13, b"key-30"), entry(2, 14, b"key-15"), entry(0, 5, b"key-11", None, 600, True)]
    df = frame(spark, rows)
    meta = runs.run_meta(df)
    chosen = compaction.inputs(meta, trigger=4)
    assert sorted((r.level, r.run) for r in chosen.collect()) == [*[(0, r) for r in range(6)], (1, 11), (1, 12)]
    merged = compaction.merge(df, chosen)
    got = pairs(merged, "tombstone")
    assert got[b"key-11"] == (None, True) and got[b"key-12"] == (b"4", False) and got[b"key-19"] == (b"fresh", False) and got[b"key-05x"] == (b"l1", False) and len(got) == 11
    after = {(r.level, r.run): r.entry_count for r in compaction.manifest_after(meta, chosen, merged).collect()}
    assert after == {(1, 10): 2, (1, 13): 1, (2, 14): 1, (1, 15): 11}
    assert compaction.inputs(meta, trigger=7).collect() == []
    span = compaction.level0_range(meta).first()
    assert (bytes(span.min_key), bytes(span.max_key), span.runs) == (b"key-10", b"key-19", 6)


def test_scans_and_old_states(spark):
    df = memtable.apply_log(ops(spark, [(1, k, b"v") for k in (b"a", b"ab", b"ab\xff", b"ac", b"b", b"\xff\xff", b"\xff")]))
    assert set(pairs(versions.key_prefix(df, b"ab"))) == {b"ab", b"ab\xff"} and set(pairs(versions.key_prefix(df, b"\xff"))) == {b"\xff", b"\xff\xff"}
    assert set(pairs(versions.key_range(df, b"ab", b"b"))) == {b"ab", b"ab\xff", b"ac"} and versions.key_range(df).count() == 7
    history = ops(spark, [(1, b"k", b"1"), (2, b"k", None), (1, b"k", b"3")]).withColumn("tombstone", F.col("op_type") == 2)
    assert [versions.as_of(history, i).count() for i in range(4)] == [0, 1, 0, 1]


def test_read_amplification(spark):
    rows = [entry(0, 1, b"a"), entry(0, 2, b"a"), entry(1, 3, b"a"), entry(1, 3, b"b")]
    got = {bytes(r.key_bytes): (r.versions, r.runs) for r in versions.read_amplification(frame(spark, rows)).collect()}
    assert got == {b"a": (3, 3), b"b": (1, 1)}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_sums_within_groups(spark, partitions):
    from mergestone.operators.offsets import segmented_offsets

    rng = random.Random(partitions)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 9]), rng.choice([b"x", b"y"]), i, rng.choice([None, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, h binary, at int, n long").withColumn("one", F.lit(1).cast("long"))
    got = segmented_offsets(df, ["g", "h"], ["at"], ["n", "one"], partitions=partitions).collect()
    before, want = {}, {}
    for g, h, at, n in sorted(rows, key=lambda r: r[2]):
        total, count = before.get((g, h), (0, 0))
        want[at] = (total, count)
        before[(g, h)] = (total + (n or 0), count + 1)
    assert {r["at"]: (r.n_before, r.one_before) for r in got} == want and len(got) == 400
    assert segmented_offsets(df.limit(0), ["g"], ["at"], ["n"]).collect() == []


def test_filters_of_split_runs(spark):
    rows = [(1, 0, run, b"%d" % i, b"", False, i, i) for run, n in ((1, 500), (2, 3)) for i in range(n)]
    for most in (50, 10**6):
        got = {r.run: (r["keys"], r.rejected, r.false_positives) for r in runs.bloom_probe(spark.createDataFrame(rows, ENTRIES), filter_keys=most).collect()}
        assert {k: v[:2] for k, v in got.items()} == {1: (500, 0), 2: (3, 0)} and got[1][2] < 30


def test_only_wanted_keys_are_resolved(spark):
    rows = [(1, 0, run, key, b"v%d" % run, False, run, run) for run in (1, 2) for key in (b"a", b"b", b"c")]
    wanted = spark.createDataFrame([(1, b"b"), (1, b"b"), (1, b"x")], "store_id int, key_bytes binary")
    kept = versions.wanted_only(spark.createDataFrame(rows, ENTRIES), wanted)
    assert sorted((bytes(r.key_bytes), r.run) for r in kept.collect()) == [(b"b", 1), (b"b", 2)]
    got = versions.multi_get(wanted, versions.latest(kept)).collect()
    assert {bytes(r.key_bytes): (r.found, r.value_bytes and bytes(r.value_bytes)) for r in got} == {b"b": (True, b"v2"), b"x": (False, None)}


def test_number_of_tasks(spark, tmp_path):
    from mergestone import session

    assert session.tasks_for(spark.createDataFrame([(1,)], "a int")) == 4  # of unknown size: the session's number
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    joined = table.join(table.withColumnRenamed("id", "x"), F.col("id") == F.col("x"))
    assert session.tasks_for(joined) == 4
    with session.shuffle_tasks(spark, 9):
        assert session.parallelism(spark) == 9
    assert session.parallelism(spark) == 4
