"""Operator 9: packing by shortest-pack-first over the length histogram.

A document's ids are cut into pieces of ``size`` ids and one rest, so a piece's length depends on its document alone.
Pieces are counted by length; the histogram has at most ``size`` rows whatever the input, and only it reaches the
driver. There lengths are placed longest first, each into the packs that are shortest so far: all packs of one pattern
at a time, which splits at most one pattern for each step. The result is a table of slots: for a length, the ranks
from ``first`` on that lie at ``offset`` in the sequences from ``sequence`` on. Pieces get their rank within their
length in Spark (numbers within many small groups, plus the counts of the groups before) and are joined to their slot.

Defined results: a null text is empty and packs its end id alone; rows that repeat a doc_id are packed as further
documents with that id; a null doc_id is carried as null; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .codec import ByteBpe, once
from .common import map_arrow, materialize, table, text_bytes

#: Pieces of one length that are numbered together, on average.
GROUP_ROWS = 1_000


def place(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, first, count, sequence, offset)``: the pieces of ``length`` with the ranks ``first .. first+count-1``
    lie at ``offset`` in the sequences ``sequence .. sequence+count-1``.

    Packs of one pattern are a run of sequences; the shortest run takes the next length for as many of its packs as
    there are pieces, and the rest of it stays as it was.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # filled length -> runs (first sequence, count)
    slots, made = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and open_runs and (filled := min(open_runs)) + length <= size:
            runs = open_runs[filled]
            sequence, count = runs.pop()
            if not runs:
                del open_runs[filled]
            take = min(left, count)
            slots.append((length, rank, take, sequence, filled))
            if take < count:
                open_runs.setdefault(filled, []).append((sequence + take, count - take))
            if filled + length < size:
                open_runs.setdefault(filled + length, []).append((sequence, take))
            rank, left = rank + take, left - take
        if left:
            slots.append((length, rank, left, made, 0))
            if length < size:
                open_runs.setdefault(length, []).append((made, left))
            made += left
    return slots


def padding(slots: list[tuple[int, int, int, int, int]], size: int) -> tuple[int, int]:
    """Ids held and padding added: a sequence is padded to ``size`` unless its length is a power of two."""
    ends: Counter = Counter()
    for length, _, count, _, offset in slots:
        ends[offset + length] += count
        ends[offset] -= count * (offset > 0)
    held = sum(length * count for length, _, count, _, _ in slots)
    return held, sum((size - end) * count for end, count in ends.items() if end & (end - 1))


def _pieces(ranks_path: str, pattern: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = once(ByteBpe, ranks_path, pattern), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(bpe.encode(str(text.as_py() or b"", "utf-8", "replace")) + end)
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> ``(doc_id, start, length, ids_crc32, doc_tokens)``, a row for each piece of at most ``size`` ids."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return map_arrow(source, _pieces(ranks_path, pattern, end_id, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` must be materialised and have ``doc_id, start, length, ids_crc32``."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    slots = place(histogram, size)
    slot_rows = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, first long, count long, sequence long, offset long")
    # The slots grow with the lengths (2 * size at most for each), not with the rows; one length's slots are an array.
    by_length = slot_rows.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "count", "sequence", "offset"))).alias("__slots"), F.sum("count").alias("__n"))
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.ceil(F.col("__n") / GROUP_ROWS))
    salted = pieces.join(F.broadcast(by_length.select("length", "__n")), "length").withColumn("__group", group).drop("__n")
    counts = salted.groupBy("length", "__group").count()
    before = counts.withColumn("__before", F.sum("count").over(W.partitionBy("length").orderBy("__group").rowsBetween(W.unboundedPreceding, -1)))
    number = F.row_number().over(W.partitionBy("length", "__group").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("__number", number).join(before.select("length", "__group", "__before"), ["length", "__group"])
    ranked = ranked.withColumn("__rank", F.col("__number") + F.coalesce("__before", F.lit(0)))
    joined = ranked.join(F.broadcast(by_length.drop("__n")), "length")
    slot = F.element_at(F.filter("__slots", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") < s["first"] + s["count"])), 1)
    placed = joined.withColumn("__slot", slot)
    return placed.withColumn("sequence_id", F.col("__slot.sequence") + F.col("__rank") - F.col("__slot.first")).withColumn("offset", F.col("__slot.offset")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, size: int = 2048, end_id: int = 1, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` -> a row for each piece with its place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return pack_pieces(materialize(token_pieces(docs, ranks_path, pattern, end_id, size), "pieces"), size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
