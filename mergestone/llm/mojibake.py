"""Garbled text from wrong character encoding (problem 9), over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm.garbling import repair

REPAIRED = "doc_id long, text string, repaired string, found boolean, lost boolean, layers int"


def _repair(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        texts = b.column(1)
        done = [repair(t) for t in texts.to_pylist()]
        fields = [[r.text for r in done], [r.found for r in done], [r.lost for r in done], [r.layers for r in done]]
        arrays = [pa.array(x, t) for x, t in zip(fields, (pa.string(), pa.bool_(), pa.bool_(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), texts, *arrays], names=["doc_id", "text", "repaired", "found", "lost", "layers"])


def repair_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, repaired, found, lost, layers) for every row, by round-trip repair (see garbling.py).

    ``found``: the text holds characters that came from decoding with a wrong encoding. ``lost``: part of the original can't
    be restored; ``repaired`` then has what can. Null and empty texts are never cases and come back as they are.
    Rows with equal ids are taken each for itself; other columns of df are ignored. No shuffle.

    Whole texts go to Python in Arrow batches; those of plain ASCII return at once.
    """
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return docs.mapInArrow(_repair, REPAIRED)


def garbled(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of repair_texts that are garbled. Texts of plain ASCII without a character reference never reach Python."""
    suspect = F.col(text_column).rlike("[^\\x00-\\x7f]|&[A-Za-z#]")
    return repair_texts(df.where(suspect), id_column, text_column).where("found")
