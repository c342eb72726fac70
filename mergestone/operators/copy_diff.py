"""Differences between two copies of a table (problem 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_copies(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(store_id, key_bytes, diff) of two copies with the columns of kvpair_primary; other columns are ignored.

    A copy's row for a key is the one of the greatest log_index; repeated rows count once, and rows that tie
    in log_index are taken by term, tombstone and value, the greatest first (nulls least). ``diff`` is
    'only_primary', 'only_replica', or 'value', 'term', 'tombstone' for each field that differs. A null value equals
    an empty one; two nulls are equal in every field, a null and a number differ. Rows with a null key or
    store are no row of the copy. Empty copies are legal: all keys are then on one side.

    One shuffle, by (store, key): both sides are combined before it, so however often a row is repeated it
    travels once for each input partition. Each side is then unpivoted to key-field-cell rows with sign +1 or -1,
    and equal cells cancel inside the same partitions.
    """
    sides = []
    for sign, side in ((1, primary), (-1, replica)):
        sides.append(
            side.where(F.col("key_bytes").isNotNull() & F.col("store_id").isNotNull()).select(
                "store_id", "key_bytes", F.lit(sign).alias("sign"),
                F.struct("log_index", "term", "tombstone", F.coalesce("value_bytes", F.lit(b"")).alias("value")).alias("row"),
            )
        )
    latest = reduce(DataFrame.unionByName, sides).groupBy("store_id", "key_bytes").agg(
        *[F.max(F.when(F.col("sign") == sign, F.col("row"))).alias(name) for sign, name in ((1, "plus"), (-1, "minus"))]
    )

    def cells(side: str, sign: int) -> list:
        text = lambda c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("null")).cast("binary")
        named = (("row", F.lit(b"")), ("value", F.col(f"{side}.value")), ("term", text("term")), ("tombstone", text("tombstone")))
        return [F.when(F.col(side).isNotNull(), F.struct(F.lit(f).alias("field"), c.alias("cell"), F.lit(sign).alias("sign"))) for f, c in named]

    unpivoted = latest.select("store_id", "key_bytes", F.explode(F.filter(F.array(*cells("plus", 1), *cells("minus", -1)), lambda c: c.isNotNull())).alias("c"))
    signed = unpivoted.groupBy("store_id", "key_bytes", "c.field", "c.cell").agg(F.sum("c.sign").alias("sign")).where(F.col("sign") != 0)
    by_key = signed.groupBy("store_id", "key_bytes").agg(
        F.max(F.when(F.col("field") == "row", F.col("sign"))).alias("alone"), F.collect_set(F.when(F.col("field") != "row", F.col("field"))).alias("fields")
    )
    diffs = F.when(F.col("alone") == 1, F.array(F.lit("only_primary"))).when(F.col("alone") == -1, F.array(F.lit("only_replica"))).otherwise(F.col("fields"))
    return by_key.select("store_id", "key_bytes", F.explode(diffs).alias("diff"))
