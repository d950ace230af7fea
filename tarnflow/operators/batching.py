"""Greedy batches over rows in order, in parallel: jump tables of blocks, composed in groups, then walked down again.

Where a batch starts decides where the next one does, all the way from a family's first row. But a batch has at most
``max_items`` rows, so the first start in a block of rows is one of its first ``max_items``. A block and the first rows of the
next tell, for each of these, where the first start in the next block would be and how many batches lie between: prefix sums,
a binary search for each row's next start, and pointer doubling until all pointers have left the block. Tables of neighbouring
blocks compose to one of the whole group, groups to larger ones; from the one start that is known, the first row, the starts
of all groups and blocks follow. No task holds more than a block or a group of tables, however large a family is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import map_batches, runs_of
from ..functions.scratch import written

#: Rows of a block, at least four times those of a batch; and the tables composed in one task (at 50,000 items 50 MB).
BLOCK_ROWS, GROUP_TABLES = 200_000, 64
#: Rows of counts or starts that a broadcast may hold, 40 bytes each.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> the same with their task and their number in it within their family."""
    part, family, at = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        numbers = []
        for name in batch.column(0).to_pylist():
            family, at = (name, 0) if name != family else (family, at + 1)
            numbers.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(numbers, pa.int64())], names=["family_id", "chunk_id", "size", "part", "at"])


def next_starts(sizes: np.ndarray, max_items: int, max_size: int) -> np.ndarray:
    """For each row the start of the batch after one that starts there."""
    upto = np.r_[0, np.cumsum(sizes)]
    rows = np.arange(len(sizes))
    fits = np.searchsorted(upto, upto[:-1] + max_size, side="right") - 1
    return np.maximum(rows + 1, np.minimum(rows + max_items, fits))


def jump_table(sizes: np.ndarray, own: int, entries: int, max_items: int, max_size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a block's first ``entries`` rows: the first start after its ``own`` rows, and the batches until there."""
    to = np.r_[next_starts(sizes, max_items, max_size)[:own], np.arange(own, len(sizes) + 1)]
    batches = np.r_[np.ones(own, np.int64), np.zeros(len(sizes) + 1 - own, np.int64)]
    while (to[:entries] < own).any():
        batches, to = batches + batches[to], to[to]
    return to[:entries] - own, batches[:entries]


def _tables(max_items: int, max_size: int):
    """Rows ``(family_id, block, number, own, size)`` in order -> each block's jump table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, block), rows in runs_of(batches, 2):
            own = int(rows["own"].to_numpy().sum())
            if own:
                to, counts = jump_table(rows["size"].to_numpy(), own, min(own, max_items), max_items, max_size)
                yield pa.RecordBatch.from_arrays([pa.array([family], rows.schema.field(0).type), pa.array([block], pa.int64()), pa.array([to], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=["family_id", "block", "exits", "counts"])

    return run


def _follow(to: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where starts in a block leave it; one beyond its last row (only a family's last block is so short) passes through."""
    inside = start < len(to)
    at = np.where(inside, start, 0)
    return np.where(inside, to[at], start), np.where(inside, counts[at], 0)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jump tables ``(family_id, group, block, exits, counts)`` in order -> one for each group."""
    for (family, group), rows in runs_of(batches, 2):
        to = counts = None
        for exits, more in zip(rows["exits"], rows["counts"], strict=True):
            exits, more = exits.values.to_numpy(), more.values.to_numpy()
            if to is None:
                to, counts = exits, more
            else:
                to, added = _follow(exits, more, to)
                counts = counts + added
        yield pa.RecordBatch.from_arrays([pa.array([family], rows.schema.field(0).type), pa.array([group], pa.int64()), pa.array([to], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=["family_id", "block", "exits", "counts"])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jump tables with their group's ``start`` and ``batch``, in order -> the start and batch of each block."""
    for (family, _), rows in runs_of(batches, 2):
        start, batch = rows["start"][0].as_py(), rows["batch"][0].as_py()
        starts, numbers = [], []
        for exits, counts in zip(rows["exits"], rows["counts"], strict=True):
            starts.append(start)
            numbers.append(batch)
            to, more = _follow(exits.values.to_numpy(), counts.values.to_numpy(), np.array([start]))
            start, batch = int(to[0]), batch + int(more[0])
        yield pa.RecordBatch.from_arrays([pa.array([family] * len(starts), rows.schema.field(0).type), rows["block"].combine_chunks(), pa.array(starts, pa.int64()), pa.array(numbers, pa.int64())], names=["family_id", "block", "start", "batch"])


def _assigned(max_items: int, max_size: int):
    """Rows ``(family_id, block, number, chunk_id, size, start, batch)`` in order -> the batch of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs_of(batches, 2):
            to = next_starts(rows["size"].to_numpy(), max_items, max_size)
            opens = np.zeros(len(to), np.int64)
            at = rows["start"][0].as_py()
            while at < len(to):
                opens[at] = 1
                at = int(to[at])
            numbers = rows["batch"][0].as_py() - 1 + np.cumsum(opens)
            yield pa.RecordBatch.from_arrays([rows["family_id"].combine_chunks(), rows["chunk_id"].combine_chunks(), pa.array(numbers)], names=["family_id", "chunk_id", "batch_no"])

    return run


def pack_embedding_batches(rows: DataFrame, max_items: int = 50_000, max_size: int = 188_743_680, size_col: str = "bytes", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows(family_id, position, chunk_id, bytes)`` -> ``(family_id, chunk_id, batch_no)``: greedy in the order of a family.

    A row opens a new batch where the open one has ``max_items`` rows or its sizes would come over ``max_size``; a row over it
    alone is a batch. With the words of chunks as ``size_col``, 2,040 items and 298,000 words it is the second form of the rule.
    A null size is 0, rows without a family are a family of their own. Starts Spark jobs when called.
    """
    kinds = dict(rows.dtypes)
    family, chunk = f"family_id {kinds['family_id']}", f"chunk_id {kinds['chunk_id']}"
    width = max(block_rows, 4 * max_items)
    order = ["family_id", "position", "chunk_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("family_id", "chunk_id", F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    known = written(map_batches(ordered, _numbered, f"{family}, {chunk}, size long, part int, at long"))
    parts = known.groupBy("family_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("family_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select(F.col("family_id").alias("family"), F.col("part").alias("its_part"), before.alias("before")))
    same = F.col("family_id").eqNullSafe(F.col("family"))
    number = F.col("at") + F.col("before")
    placed = known.join(_small(parts), same & (F.col("part") == F.col("its_part"))).select("family_id", F.floor(number / width).alias("block"), number.alias("number"), "chunk_id", "size")
    placed = written(placed)

    ahead = placed.filter((F.col("block") > 0) & (F.col("number") % width < max_items)).withColumn("block", F.col("block") - 1)
    around = placed.withColumn("own", F.lit(1)).unionByName(ahead.withColumn("own", F.lit(0))).select("family_id", "block", "number", "own", "size")
    dealt = around.repartition("family_id", "block").sortWithinPartitions("family_id", "block", "number")
    table = f"{family}, block long, exits array<long>, counts array<long>"
    levels = [written(map_batches(dealt, _tables(max_items, max_size), table))]
    grouped = lambda t: t.withColumn("group", F.floor(F.col("block") / GROUP_TABLES)).select("family_id", "group", "block", "exits", "counts")
    while levels[-1].filter("block > 0").limit(1).count():
        ordered = grouped(levels[-1]).repartition("family_id", "group").sortWithinPartitions("family_id", "group", "block")
        levels.append(written(map_batches(ordered, _composed, table)))

    starts = levels[-1].select("family_id", "block", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("batch"))
    of = lambda s, block: s.select(F.col("family_id").alias("family"), F.col("block").alias(block), "start", "batch")
    for level in reversed(levels[:-1]):
        found = grouped(level).join(_small(of(starts, "its_group")), same & (F.col("group") == F.col("its_group"))).select("family_id", "group", "block", "exits", "counts", "start", "batch")
        ordered = found.repartition("family_id", "group").sortWithinPartitions("family_id", "group", "block")
        starts = written(map_batches(ordered, _entered, f"{family}, block long, start long, batch long"))

    found = placed.join(_small(of(starts, "its_block")), same & (F.col("block") == F.col("its_block"))).select("family_id", "block", "number", "chunk_id", "size", "start", "batch")
    ordered = found.repartition("family_id", "block").sortWithinPartitions("family_id", "block", "number")
    return map_batches(ordered, _assigned(max_items, max_size), f"{family}, {chunk}, batch_no long")
