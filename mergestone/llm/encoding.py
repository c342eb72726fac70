"""Encoding a corpus with a public tokenizer (problem 7): overlapping chunks, stitched where pre-tokens resynchronise."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergestone.llm.tokens import VOCABULARY, encode_batch, safe_boundaries

#: Texts of more characters than this are cut into chunks of so many, each going on OVERLAP characters into the next.
CHUNK_CHARS = 8_192
OVERLAP = 512
#: Chunks of a text that are in memory as rows at a time.
PIECES = 256


def _encoder(vocabulary: str, count: bool):
    """Encodes whole texts: (doc_id, ids), or (doc_id, n_tokens)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            offsets, values = encode_batch(b.column(1).to_pylist(), vocabulary)
            out = pa.array(offsets[1:] - offsets[:-1]) if count else pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "n_tokens" if count else "ids"])

    return run


def _cutter(chunk: int, overlap: int):
    """Cuts texts into chunks that go on ``overlap`` characters into the next. A text is known by its digest and document."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.string())
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                digest = hashlib.md5(text.encode(), usedforsecurity=False).digest() + (b"" if doc is None else doc.to_bytes(8, "big", signed=True))
                for first in range(0, len(text), chunk * PIECES):
                    starts = range(first, min(len(text), first + chunk * PIECES), chunk)
                    columns = [[digest] * len(starts), [doc] * len(starts), [s // chunk for s in starts], [text[s : s + chunk + overlap] for s in starts]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["row_id", "doc_id", "piece", "text"])

    return run


def _boundaries(chunk: int, overlap: int):
    """For each chunk: safe boundaries in its head (the previous chunk's overlap) and in its tail (its own overlap)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            heads, tails = [], []
            for piece, text in zip(b.column("piece").to_pylist(), b.column("text").to_pylist()):
                start = piece * chunk
                at = safe_boundaries(text, start, start + 1, start + chunk + overlap)
                heads.append([x for x in at if x <= start + overlap])
                # the last pre-token may be cut, but its start is sure
                tails.append([x for x in at if x >= start + chunk])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "head", "tail"])

    return run


def _assembler(vocabulary: str, count: bool):
    """Encodes the pieces of texts that come in order, part by part, and puts each text's ids together.

    A part with ``joins`` goes on the piece before it: between them no boundary was found.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        current, parts, held, done = None, [], [], []

        def encode() -> None:
            if parts:
                held.append(encode_batch(["".join(parts)], vocabulary)[1])
                parts.clear()

        def close() -> None:
            encode()
            ids = np.concatenate(held) if held else np.empty(0, np.int32)
            done.extend([(current[1], ids)] * current[2])
            held.clear()

        def out():
            docs = pa.array([d for d, _ in done], pa.int64())
            if count:
                second = pa.array([len(x) for _, x in done], pa.int32())
            else:
                offsets = np.zeros(len(done) + 1, np.int32)
                np.cumsum([len(x) for _, x in done], out=offsets[1:])
                second = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for _, x in done])))
            done.clear()
            return pa.RecordBatch.from_arrays([docs, second], names=["doc_id", "n_tokens" if count else "ids"])

        for b in batches:
            for row, doc, copies, joins, part in zip(*(b.column(c).to_pylist() for c in ("row_id", "doc_id", "copies", "joins", "part"))):
                if current is None or row != current[0]:
                    if current is not None:
                        close()
                    current = (row, doc, copies)
                if not joins:
                    encode()
                parts.append(part)
            if done:
                yield out()
        if current is not None:
            close()
            yield out()

    return run


def stitched_parts(docs: DataFrame, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Cuts long texts (doc_id, text) into parts (row_id, doc_id, piece, copies, joins, part) that together are the text.

    Chunks are pre-tokenised in parallel. Chunk i and i + 1 share ``overlap`` characters; the first safe boundary they both
    see there is where the second has fallen into step, and part i runs from chunk i's own such place to that one. Where
    two chunks find none (a pre-token longer than the overlap), the later part ``joins`` the earlier: only these are encoded
    together. Equal rows (the same document and text) are one, with their number in ``copies``.
    """
    cut = docs.mapInArrow(_cutter(chunk, overlap), "row_id binary, doc_id long, piece int, text string")
    chunks = cut.groupBy("row_id", "doc_id", "piece").agg(F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("copies"))
    seen = chunks.mapInArrow(_boundaries(chunk, overlap), "row_id binary, doc_id long, piece int, text string, copies int, head array<long>, tail array<long>")
    by = Window.partitionBy("row_id").orderBy("piece")
    start = F.col("piece").cast("long") * chunk
    sync = seen.withColumn("begin", F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(by), "head"))))
    sync = sync.withColumn("next", F.lead("begin").over(by)).withColumn("last", F.lead("piece").over(by).isNull())
    begin = F.coalesce("begin", start)
    end = F.when(F.col("last"), start + F.length("text")).otherwise(F.coalesce("next", start + chunk))
    part = F.substring("text", (begin - start + 1).cast("int"), (end - begin).cast("int"))
    return sync.select("row_id", "doc_id", "piece", "copies", F.col("begin").isNull().alias("joins"), part.alias("part"))


def _encoded(df: DataFrame, id_column: str, text_column: str, vocabulary: str, chunk: int, overlap: int, count: bool) -> DataFrame:
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    long, schema = F.length("text") > chunk, f"doc_id long, {'n_tokens int' if count else 'ids array<int>'}"
    short = docs.where(F.col("text").isNull() | ~long).mapInArrow(_encoder(vocabulary, count), schema)
    parts = stitched_parts(docs.where(long), chunk, overlap).sortWithinPartitions("row_id", "piece")  # as the window leaves them
    return short.unionByName(parts.mapInArrow(_assembler(vocabulary, count), schema))


def encode_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) for every row: the ids of its text, without special tokens.

    A null text and an empty one have an empty list. Text that looks like a special token is plain text. Rows with the
    same id, or a null id, are encoded each for itself. Other columns of df are ignored. An empty table gives none.

    Texts of up to ``chunk`` characters are encoded where they are read, without a shuffle; the chunks of longer ones are
    spread over all tasks (see stitched_parts) and only they are shuffled. Equal to encoding each text whole.
    """
    return _encoded(df, id_column, text_column, vocabulary, chunk, overlap, count=False)


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens) for every row, by the same encoding; the ids don't leave the Python workers."""
    return _encoded(df, id_column, text_column, vocabulary, chunk, overlap, count=True)
