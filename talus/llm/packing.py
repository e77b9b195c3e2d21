"""Filling containers of fixed capacity by bounded-space best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.staging import Staged

#: Open windows per partition.
WINDOWS = 128
#: Partitions whose leftovers one task merges.
MERGED_PARTITIONS = 64


class Windows:
    """At most ``limit`` open containers; an item goes to the fullest in which it fits."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.next = capacity, limit, 0
        self.open: list[tuple[int, int]] = []  # (room, number), ascending

    def place(self, size: int) -> tuple[int, int, tuple[int, int] | None]:
        """(container, position in it, the container closed for it): best fit, or a new one in place of the fullest."""
        closed = None
        i = bisect_left(self.open, (size, -1))
        if i == len(self.open):
            if len(self.open) == self.limit:
                closed = self.open.pop(0)
            room, number = self.capacity, self.next
            self.next += 1
        else:
            room, number = self.open.pop(i)
        insort(self.open, (room - size, number))
        return number, self.capacity - room, closed


def _packer(capacity: int, limit: int):
    """Packs one partition's rows (item key columns..., size): adds part, start, size, container number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        pid, windows = context.partitionId() if context else 0, Windows(capacity, limit)
        last = None
        for batch in batches:
            last = batch.schema
            rows, parts, starts, sizes, numbers, fills = [], [], [], [], [], []
            for i, size in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                cuts = [capacity] * (size // capacity) + ([size % capacity] if size % capacity or not size else [])
                for k, piece in enumerate(cuts):
                    number, start, _ = windows.place(piece)
                    rows.append(i), parts.append(k), starts.append(start), sizes.append(piece), numbers.append(number)
            keys = batch.select(range(batch.num_columns - 1)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(parts, pa.int32()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array([pid] * len(rows), pa.int32()), pa.array(numbers, pa.int64()), pa.array([False] * len(rows))], [*keys.schema.names, "part_no", "start", "n_tokens", "pid", "number", "leftover"])
        if windows.open and last is not None:  # one row without item for each container that is still open: its fill
            n = len(windows.open)
            empty = [pa.nulls(n, f.type) for f in list(last)[:-1]]
            fills = [capacity - room for room, _ in windows.open]
            yield pa.RecordBatch.from_arrays([*empty, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(fills, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array([k for _, k in windows.open], pa.int64()), pa.array([True] * n)], [*list(last.names)[:-1], "part_no", "start", "n_tokens", "pid", "number", "leftover"])

    return run


def _merger(capacity: int, limit: int):
    """Packs leftover containers as items: (pid, number, fill) to (pid, number, task, container, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, windows = context.partitionId() if context else 0, Windows(capacity, limit)
        for batch in batches:
            placed = [windows.place(fill)[:2] for fill in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([task] * len(placed), pa.int32()), pa.array([c for c, _ in placed], pa.int64()), pa.array([s for _, s in placed], pa.int32())], ["pid", "number", "task", "container", "shift"])

    return run


def pack(items: DataFrame, keys: list[str], size: str, capacity: int, windows: int = WINDOWS, merged: int = MERGED_PARTITIONS) -> DataFrame:
    """``keys``, part_no, container_id, start, n_tokens: every item in a container, at ``start`` in it.

    An item is split only if it alone exceeds ``capacity``, into full parts and
    a rest; every other item is one part.  Every partition keeps ``windows`` open
    containers, places an item in the fullest in which it fits and closes the
    fullest when none fits.  What is still open at the end, at most ``windows``
    containers a partition, is packed once more as whole containers, those of
    ``merged`` partitions in one task.  Items of size zero and null sizes take no
    room but get a container; repeated rows are items of their own.  An empty
    table gives no rows.
    """
    keep = Staged(items.sparkSession, "pack")
    kinds = dict(items.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    sized = items.select(*keys, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("_size"))
    placed = keep(sized.mapInArrow(_packer(capacity, windows), f"{named}, part_no int, start int, n_tokens int, pid int, number bigint, leftover boolean"))
    open_ = placed.where("leftover").select("pid", "number", F.col("n_tokens").alias("fill"))
    last = placed.where("leftover").agg(F.max("pid")).first()[0] or 0
    tasks = 1 + last // merged
    grouped = open_.repartition(tasks, (F.col("pid") / merged).cast("int")).sortWithinPartitions(F.desc("fill"), "pid", "number")
    moved = keep(grouped.mapInArrow(_merger(capacity, windows), "pid int, number bigint, task int, container bigint, shift int"))
    identity = lambda kind, a, b: F.concat_ws("-", F.lit(kind), F.col(a), F.col(b))
    out = placed.where("not leftover").join(moved, ["pid", "number"], "left")
    return out.select(
        *keys,
        "part_no",
        F.when(F.col("task").isNull(), identity("c", "pid", "number")).otherwise(identity("m", "task", "container")).alias("container_id"),
        (F.col("start") + F.coalesce("shift", F.lit(0))).alias("start"),
        "n_tokens",
    )
