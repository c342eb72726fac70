"""The log as a stream: late and repeated records, restarts, and agreement with the batch form."""

import random

from mergestone.session import shared_path
from mergestone.streaming.log_stream import latest_by_stream, replay, state_of

WAL = "store_id int, segment int, term long, log_index long, op_type tinyint, key_bytes binary, value_bytes binary"


def test_stream_in_any_order_and_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, 1, 1, i, rng.choice([1, 1, 2]), b"k%d" % rng.randrange(9), b"v%d" % i) for i in range(200)]
    want = {bytes(r[5]): (r[3], r[4]) for r in rows}
    dirty = rows + rng.sample(rows, 60) + [(1, 1, 1, 999, 0, b"k1", b""), (1, 1, 1, 998, 1, None, b"")]
    rng.shuffle(dirty)
    source, out, checkpoint = str(tmp_path / "in"), shared_path(spark, "stream-test"), shared_path(spark, "stream-test")
    spark.createDataFrame(dirty[:130], WAL).repartition(3).write.parquet(source)
    assert replay(spark, source, out, checkpoint, files_per_batch=1) == 3
    spark.createDataFrame(dirty[130:], WAL).repartition(2).write.mode("append").parquet(source)
    assert replay(spark, source, out, checkpoint) >= 1
    assert {bytes(r.key_bytes): (r.log_index, r.op_type) for r in state_of(spark, out).collect()} == want
    assert {bytes(r.key_bytes): (r.log_index, r.op_type) for r in latest_by_stream(spark, source).collect()} == want
