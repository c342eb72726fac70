"""Filling fixed-capacity containers with items (problem 8): best-fit decreasing over a segment tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.session import materialize, parallelism

CAPACITY = 2_048
#: Tokens of a group, which is packed as one. Items are spread by hash, so each group is a fair mixture of sizes.
GROUP_TOKENS = 4_000_000
GROUPS_PER_TASK = 256
#: Half-empty containers, one a group, that are packed together.
LEFTOVERS = 65_536


class OpenBins:
    """Open bins by remaining capacity: a segment tree that counts them, with a stack of bins at each leaf."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least remaining capacity that is at least ``size``: (bin, room), or None."""
        i = size + self.leaves
        if not self.count[i]:
            # up to the first subtree on the right that has a bin, then down its left side
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i <<= 1
                if not self.count[i]:
                    i += 1
        room = i - self.leaves
        which = self.bins[room].pop()
        self._add(room, -1)
        return which, room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. ``sizes`` must fall, none may exceed the capacity; an item of size 0 goes into any bin."""
    packer = Packer(capacity)
    return [packer.place(s) for s in sizes]


class Packer:
    """Places items one at a time, the largest first."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.open, self.n = capacity, OpenBins(capacity), 0

    def place(self, size: int) -> int:
        found = self.open.tightest(size)
        if found is None:
            which, room = self.n, self.capacity
            self.n += 1
        else:
            which, room = found
        self.open.put(room - size, which)
        return which


def split_items(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, first_token, n_tokens): a text of at most ``capacity`` tokens is one item, a longer one full parts and a rest."""
    n = F.col("n_tokens")
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / capacity) - 1).cast("int"))).alias("part")
    items = counts.select("doc_id", "n_tokens", parts).withColumn("first_token", F.col("part") * capacity)
    return items.select("doc_id", "part", "first_token", F.least(F.lit(capacity), n - F.col("first_token")).cast("int").alias("n_tokens"))


def _pack(capacity: int, stride: int):
    """Best-fit decreasing over a partition sorted by (group, falling size). Container numbers are group * stride + bin."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        packer, current = None, None
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            out = []
            for group, size in zip(col["group"].to_pylist(), col["n_tokens"].to_pylist()):
                if group != current:
                    packer, current = Packer(capacity), group
                out.append(group * stride + packer.place(size))
            keep = [n for n in b.schema.names if n != "group"]
            yield pa.RecordBatch.from_arrays([*(col[n] for n in keep), pa.array(out, pa.int64())], names=[*keep, "container"])

    return run


def pack(counts: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, leftovers: int = LEFTOVERS) -> DataFrame:
    """(container, doc_id, part, first_token, n_tokens): every item of ``counts`` (doc_id, n_tokens) in one container.

    No container holds more than ``capacity`` tokens. Only a text of more tokens is split: into full containers' worth and a
    rest. A text without tokens is an item of size 0 and stands in some container. Rows with the same id are items of
    their own; a null count is a size of 0. An empty table gives no containers.

    Items are spread by hash over groups of about ``group_tokens`` tokens and packed best-fit decreasing within each; a task takes up
    to ``GROUPS_PER_TASK`` groups, one after the other, so neither its memory nor the number of tasks grows out of hand. A group
    can leave at most one container half empty or emptier (a second one's items would have fitted into it). Those, one a
    group, are packed as items of their fill, again in groups, of ``leftovers`` containers, level by level until one group is left.
    """
    sized = materialize(split_items(counts.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n_tokens")), capacity), "items")
    total = sized.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
    groups, stride = max(1, math.ceil(total / group_tokens)), 1 << 32
    grouped = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)).cast("int"))
    packed = materialize(_in_groups(grouped, ["doc_id", "part", "first_token"], groups, capacity, stride), "packed")
    columns = ["container", "doc_id", "part", "first_token", "n_tokens"]
    moves, level, used = None, packed, groups
    while groups > 1:
        slack = level.groupBy("container").agg(F.sum("n_tokens").cast("int").alias("n_tokens")).where(F.col("n_tokens") * 2 <= capacity)
        groups = math.ceil(groups / leftovers)
        again = slack.select(F.col("container").alias("old"), "n_tokens", F.pmod(F.xxhash64("container"), F.lit(groups)).cast("int").alias("group"))
        level = materialize(_in_groups(again, ["old"], groups, capacity, stride).withColumn("container", F.col("container") + used * stride), "leftovers")
        step, used = level.select("old", F.col("container").alias("new")), used + groups
        if moves is None:
            moves = step
        else:  # a container that moved and whose new container moved again
            later = step.select(F.col("old").alias("new"), F.col("new").alias("newer"))
            moves = moves.join(later, "new", "left").select("old", F.coalesce("newer", "new").alias("new"))
    if moves is None:
        return packed.select(columns)
    return packed.join(moves, packed["container"] == moves["old"], "left").select(F.coalesce("new", "container").alias("container"), *columns[1:])


def _in_groups(items: DataFrame, keep: list[str], groups: int, capacity: int, stride: int) -> DataFrame:
    """(keep..., n_tokens, container) of items (keep..., n_tokens, group), each group packed on its own."""
    tasks = min(groups, max(parallelism(items.sparkSession), math.ceil(groups / GROUPS_PER_TASK)))
    laid = items.select(*keep, "n_tokens", "group").repartitionById(tasks, (F.col("group") % tasks).cast("int"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in laid.schema.fields if f.name != "group"]
    return laid.sortWithinPartitions("group", F.col("n_tokens").desc(), *keep).mapInArrow(_pack(capacity, stride), ", ".join([*kinds, "container long"]))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, containers, the least number there could be, the share of room used and the fullest container."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("items"))
    one = per.agg(F.sum("items").alias("items"), F.sum("fill").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("fill").alias("fullest"))
    return one.select(
        "items", "tokens", "containers", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / (F.col("containers") * capacity)).alias("used_share"), "fullest"
    )
