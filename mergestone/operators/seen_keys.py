"""Has this key been seen before? (problem 1)"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.operators.bloom import BlockedBloom, Geometry
from mergestone.session import materialize, parallelism, shuffle_tasks, tasks_for

TARGET_RATE = 0.001
#: Most bytes of one bucket's two filters, and so of what a task keeps in memory.
FILTER_BYTES = 16 << 20
#: Kinds of rows, in the order in which a bucket takes them.
_ASKED, _KNOWN, _INCOMING, _ABSENT = 0, 1, 2, 3
_NEW = 4


@dataclass(frozen=True)
class SeenKeys:
    """``fresh`` (key_bytes, at): records whose key was new, exactly. ``verdicts`` (key_bytes, at, kind, maybe): what the filters said.

    Of the known keys ``verdicts`` has only those that the filter of the incoming ones lets pass.
    """

    fresh: DataFrame
    verdicts: DataFrame
    geometry: Geometry
    buckets: int
    keys: int
    known: int


def _judge(asked: Geometry, earlier: Geometry):
    """Streams a partition sorted by bucket, kind and order through two filters for each bucket.

    One has the keys that will be asked for, the other the earlier keys: known ones are inserted, incoming ones queried, then inserted.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wanted, seen, current = None, None, None
        for b in batches:
            col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
            bucket, kind, h1, h2 = (col(c).to_numpy(zero_copy_only=False) for c in ("bucket", "kind", "h1", "h2"))
            maybe = np.zeros(len(bucket), dtype=bool)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if bucket[a] != current:
                    wanted, seen, current = BlockedBloom(asked), BlockedBloom(earlier), bucket[a]
                for k in (_ASKED, _KNOWN, _INCOMING, _ABSENT):
                    rows = a + np.flatnonzero(kind[a:z] == k)
                    if not len(rows):
                        continue
                    x, y = h1[rows], h2[rows]
                    if k == _ASKED:
                        wanted.add(x, y)
                    elif k == _KNOWN:
                        seen.add(x, y)
                        maybe[rows] = wanted.contains(x, y)
                    elif k == _INCOMING:
                        maybe[rows] = seen.query_then_add(x, y)
                    else:
                        maybe[rows] = seen.contains(x, y)
            keep = pa.array((kind >= _INCOMING) | (kind == _KNOWN) & maybe)
            out = pa.RecordBatch.from_arrays([col("key_bytes"), col("at"), col("kind"), pa.array(maybe)], names=["key_bytes", "at", "kind", "maybe"])
            yield out.filter(keep)

    return run


def seen_keys(known: DataFrame, incoming: DataFrame, order: str, key: str = "key_bytes", target: float = TARGET_RATE, filter_bytes: int = FILTER_BYTES, absent_probes: bool = False) -> SeenKeys:
    """Decides for each incoming record, in the order of ``order``, whether its key is among ``known`` or earlier records.

    Keys are hash-partitioned into buckets, each with a blocked Bloom filter sized for the false-positive rate ``target`` and
    the approximate number of distinct keys; a task holds one bucket's filters (at most about ``filter_bytes``) and streams the bucket
    past them: known keys are inserted, the first record of each incoming key is queried and then inserted, in order. A later record
    of a key repeats the first by definition. A filter has no false negatives, so its "new" is final and goes no further. What is
    "maybe seen" is checked exactly, by a join with those known keys that a second filter, of the keys asked for, lets pass. So
    with filters that always say "maybe" the answer would be the same, but all keys of both sides would go into that join.

    Hot keys: both sides are reduced to one row for each key, before anything is shuffled by bucket.

    A null key or order number is no record and gets no answer. Records with the same order number don't precede
    each other. Repeated known rows are one key; the empty key is a key. Empty tables are legal on both sides.
    With ``absent_probes`` every incoming key also sends a probe that no table can hold (the key lengthened
    beyond the longest), to measure the rate of wrong answers; probes are queried last, when the filters are fullest.
    """
    spark = incoming.sparkSession
    k, at = F.col(key).alias("key_bytes"), F.col(order).cast("long").alias("at")
    old = known.where(F.col(key).isNotNull()).select(k, F.lit(_KNOWN).alias("kind"), F.lit(None).cast("long").alias("at"))
    new = incoming.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(k, F.lit(_INCOMING).alias("kind"), at)
    with shuffle_tasks(spark, tasks_for(old, new)):
        firsts = materialize(old.unionByName(new).groupBy("kind", "key_bytes").agg(F.min("at").alias("at")), "first-records")
    is_known = F.col("kind") == _KNOWN
    sizes = firsts.agg(
        F.count(F.when(is_known, 1)).alias("known"), F.count(F.when(~is_known, 1)).alias("asked"), F.max(F.octet_length("key_bytes")).alias("longest"), F.approx_count_distinct("key_bytes", 0.02).alias("keys")
    ).first()
    total = Geometry.of(sizes["keys"], target).bytes + Geometry.of(sizes["asked"], target).bytes
    buckets = max(parallelism(spark), math.ceil(total / filter_bytes))
    asked, earlier = (Geometry.of(math.ceil(n / buckets), target) for n in (sizes["asked"], sizes["keys"]))
    hashed = lambda rows: rows.withColumn("h1", F.xxhash64("key_bytes")).withColumn("h2", F.xxhash64("key_bytes", F.lit(0x5EED)))
    stream = hashed(firsts.select("key_bytes", "at", "kind"))
    asking = stream.where(~is_known).withColumn("kind", F.lit(_ASKED)).withColumn("at", F.lit(None).cast("long"))
    if absent_probes:
        tail = b"\xff" * ((sizes["longest"] or 0) + 1)
        stream = stream.unionByName(hashed(firsts.where(~is_known).select(F.concat("key_bytes", F.lit(tail)).alias("key_bytes"), "at", F.lit(_ABSENT).alias("kind"))))
    # those who only ask travel as hashes
    stream = stream.unionByName(asking.withColumn("key_bytes", F.lit(None).cast("binary")))
    stream = stream.withColumn("bucket", F.pmod(F.xxhash64("h1", "h2"), F.lit(buckets)).cast("int"))
    laid = stream.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind", "at")
    verdicts = materialize(laid.mapInArrow(_judge(asked, earlier), "key_bytes binary, at long, kind int, maybe boolean"), "verdicts")
    first = verdicts.where(F.col("kind") == _INCOMING)
    wrong = first.where("maybe").join(verdicts.where(is_known).select("key_bytes"), "key_bytes", "left_anti")
    fresh = first.where(~F.col("maybe")).unionByName(wrong.select(first.columns)).select("key_bytes", "at")
    return SeenKeys(fresh, verdicts, earlier, buckets, sizes["keys"], sizes["known"])


def already_seen(known: DataFrame, incoming: DataFrame, order: str, key: str = "key_bytes", **options) -> DataFrame:
    """The order numbers of the incoming records whose key was seen before, each record once."""
    fresh = seen_keys(known, incoming, order, key, **options).fresh
    records = incoming.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("key_bytes"), F.col(order).cast("long").alias("at"))
    return records.join(fresh, ["at", "key_bytes"], "left_anti").select("at")


def error_rate(known: DataFrame, incoming: DataFrame, order: str, key: str = "key_bytes", target: float = TARGET_RATE, **options) -> DataFrame:
    """One row: how often the filters said "seen" for keys known to be absent, what they cost and what they spared.

    ``probes`` and ``false_positives`` count lengthened keys; ``new_keys`` and ``wrong_new_keys`` the incoming keys that are new and those
    of them that only the exact check found to be. ``checked_keys`` of ``incoming_keys`` and ``possible_known`` of ``known_keys`` went into
    that check.
    """
    seen = seen_keys(known, incoming, order, key, target=target, absent_probes=True, **options)
    n = lambda kind, wrong=None: F.count(F.when((F.col("kind") == kind) & (F.lit(True) if wrong is None else F.col("maybe") == wrong), 1))
    rows = seen.verdicts.select("kind", "maybe").unionByName(seen.fresh.select(F.lit(_NEW).alias("kind"), F.lit(None).cast("boolean").alias("maybe")))
    counts = rows.agg(
        n(_ABSENT).alias("probes"), n(_ABSENT, True).alias("false_positives"), n(_INCOMING).alias("incoming_keys"), n(_INCOMING, True).alias("checked_keys"), n(_KNOWN).alias("possible_known"), n(_INCOMING, False).alias("said_new"), n(_NEW).alias("new_keys")
    )
    return counts.select(
        "probes", "false_positives", (F.col("false_positives") / F.greatest(F.col("probes"), F.lit(1))).alias("measured_rate"), F.lit(target).alias("target_rate"),
        "new_keys", (F.col("new_keys") - F.col("said_new")).alias("wrong_new_keys"), "incoming_keys", "checked_keys", F.lit(seen.known).cast("long").alias("known_keys"), "possible_known",
        F.lit(seen.keys).cast("long").alias("keys_in_filters"), F.lit(seen.buckets).alias("buckets"), F.lit(seen.geometry.bytes * seen.buckets).cast("long").alias("filter_bytes"),
    )
