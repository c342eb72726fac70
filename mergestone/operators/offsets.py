"""Global prefix sums and exact offset chunking.

``global_offsets`` gives every row of a counts table the sum of the counts before it, in a total order,
without ever sorting the table in one task. ``chunked_totals`` uses it to compute per-key totals when a
few keys hold most rows: all rows get a number in key order, chunks of equal numbers of rows are
processed on their own, and only the states of keys that touch a chunk's edge are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergestone.session import materialize, shuffle_tasks, tasks_for

CHUNK_ROWS = 65_536
SPLIT_ROWS = 65_536


def with_split(df: DataFrame, columns: Sequence[str], rows_per_split: int = SPLIT_ROWS) -> tuple[DataFrame, list[Column]]:
    """A frame with ``columns``, and the columns ``split`` (a row's input split) and ``place`` (its place there) to select from it.

    A split is a run of ``rows_per_split`` rows of one file. Unlike a partition number it is the same however often the
    scan is repeated and however its tasks are laid out. A frame that isn't a plain read of Parquet files is written
    to the shared folder first.
    """
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta.getField("row_index")).schema  # noqa: B018
    except AnalysisException:
        df = materialize(df.select(*columns), "split-input")
        meta = df.metadataColumn("_metadata")
    row = meta.getField("row_index")
    return df, [F.xxhash64(meta.getField("file_path"), F.floor(row / rows_per_split)).alias("split"), row.alias("place")]


def global_offsets(counts: DataFrame, order: Sequence[str], n: str = "n", partitions: int | None = None) -> DataFrame:
    """Adds ``start``: the sum of ``n`` over all rows before this one in the order of the ``order`` columns.

    Range partitions are summed on their own; the sums of the partitions (one row for each, so their number
    is bounded by ``partitions``) are then added up. Rows equal in all order columns get their turn in an
    arbitrary but fixed order. Nulls come first. An empty table gives an empty table.
    """
    partitions = partitions or tasks_for(counts)
    schema = T.StructType([*counts.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType())])

    def local(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype("int64")
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(sizes), part, "int32")), pa.array(starts)], names=[*b.schema.names, "part", "start"])

    local_sums = materialize(counts.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(local, schema), "offsets")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = local_sums.groupBy("part").agg(F.sum(n).alias("part_n")).select("part", F.coalesce(F.sum("part_n").over(w), F.lit(0)).alias("base"))
    # one row for each of `partitions` range partitions: small by construction
    return local_sums.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def segmented_offsets(rows: DataFrame, groups: Sequence[str], order: Sequence[str], measures: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Adds ``<m>_before`` for each measure m: its sum over the rows of the same group before this one in the order of ``order``.

    What a running sum over a window by group gives, without a group ever being in one task: rows are range-partitioned by group and
    order, summed up where they are, and only a group that goes on in a later partition is given what it had before, one row
    for each end of a partition. Null measures count as 0; a null is a group of its own. An empty table gives an empty table.
    """
    partitions = partitions or tasks_for(rows)
    before = [f"{m}_before" for m in measures]
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_first", T.BooleanType()), *[T.StructField(b, T.LongType()) for b in before]])

    def local(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, last, first, carry = TaskContext.get().partitionId(), None, True, np.zeros(len(measures), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(g) for g in groups]
            change = np.zeros(n, dtype=bool)
            for c in cols:
                same = pc.equal(c.slice(1), c.slice(0, n - 1))
                both_null = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
                change[1:] |= ~np.asarray(pc.if_else(both_null, True, pc.fill_null(same, False)).to_numpy(zero_copy_only=False), dtype=bool)
            head = [c[0].as_py() for c in cols]
            change[0] = last is not None and head != last
            start = np.maximum.accumulate(np.where(change, np.arange(n), -1))  # where the row's group begins in this batch, or -1
            out = []
            for i, m in enumerate(measures):
                v = np.asarray(pc.fill_null(b.column(m), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                total = np.cumsum(v)
                exclusive = total - v
                base = np.where(start < 0, -carry[i], exclusive[np.maximum(start, 0)])
                out.append(exclusive - base)
                carry[i] = out[-1][-1] + v[-1]
            flags = (start < 0) & first
            first, last = first and bool(start[-1] < 0), [c[n - 1].as_py() for c in cols]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, "int32")), pa.array(flags), *map(pa.array, out)], names=[*b.schema.names, "_part", "_first", *before])

    laid = materialize(rows.repartitionByRange(partitions, *groups, *order).sortWithinPartitions(*groups, *order).mapInArrow(local, schema), "segmented")
    ends = laid.groupBy("_part", *groups).agg(F.max("_first").alias("_first"), *[F.sum(m).alias(f"_s{i}") for i, m in enumerate(measures)])
    w = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", "_first", *[F.sum(f"_s{i}").over(w).alias(f"_c{i}") for i in range(len(measures))]).where(F.col("_first") & F.col("_c0").isNotNull())
    # one row at most for each range partition: the group it begins with
    out = laid.join(F.broadcast(carried), ["_part", "_first"], "left")
    return out.select(*rows.columns, *[(F.col(b) + F.coalesce(F.col(f"_c{i}"), F.lit(0))).alias(b) for i, b in enumerate(before)])


def chunked_totals(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Per-key sums of ``measures`` and the number of ``rows``, by exact offset chunking.

    ``rows`` has the key columns, ``split`` and ``place`` (see with_split) and the measures as integers.
    Returns (totals, counts): totals has a row for each key, counts one for each key and split with
    its number of rows ``n`` and the number ``start`` of its first row in key order.

    Rows in which a key column is null are numbered and counted in ``counts`` but have no total. Null
    measures count as 0. Repeated rows all count. An empty table gives empty results.

    Steps: count keys by input split (combined before the shuffle); prefix-sum the counts in key order;
    number the rows of each key and split, a group no larger than a split; shuffle rows by chunk number,
    each chunk having exactly ``chunk_rows`` rows whatever the keys; sum up each chunk; merge the states of
    the keys that touch an edge of their chunk, at most two a chunk, in the order of their row numbers.
    """
    by, tasks = [*keys, "split"], tasks_for(rows)
    with shuffle_tasks(rows.sparkSession, tasks):
        counts = global_offsets(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, partitions=tasks)
    numbered = (
        rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("place")))
        .join(counts.select(*by, "start"), by)
        .withColumn("number", F.col("start") + F.col("nth") - 1)
        .withColumn("chunk", F.floor(F.col("number") / chunk_rows).cast("long"))
        .select("chunk", *keys, "number", *measures)
    )
    with shuffle_tasks(rows.sparkSession, tasks):
        states = materialize(
            numbered.repartitionById(tasks, (F.col("chunk") % tasks).cast("int"))
            .groupBy("chunk", *keys)
            .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures], F.min("number").alias("first"), F.max("number").alias("last")),
            "chunk-states",
        )
    edge = (F.col("first") % chunk_rows == 0) | (F.col("last") % chunk_rows == chunk_rows - 1)
    out = [*keys, "rows", *measures]
    inner = states.where(~edge).select(*out)
    merged = states.where(edge).groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(m).alias(m) for m in measures])
    return inner.unionByName(merged.select(*out)), counts
