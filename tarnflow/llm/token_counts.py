"""Operator 4: token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

A token file holds little-endian unsigned 16-bit ids and nothing else; id 0 ends a document, the vocabulary's ids are
stored plus one. Files are read in blocks of a fixed number of ids. In each block one vectorised search finds the end
ids; a block gives its count of ends, its ids before the first and after the last, and the lengths in between. A prefix
scan over a file's blocks (counts of ends and ids, and the place of the last end so far) stitches the documents that
cross block boundaries, however many blocks they span.

Defined results: a null or empty text is a document of 0 ids; a null id is kept; a text of any length is one document, also
beyond a block; repeated rows are further documents; ids after the last end of a file sequence are a document that has not
ended (``ended`` false); an empty table writes no ids and gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .codec import ByteBpe, once
from .common import map_arrow, scratch_dir, table, text_bytes

END, LINE_END = 0, "\u0000\u0000"
#: Ids of a block; bytes from which on a written row of documents is full, and rows of a file, which is one value in a task's
#: memory: 4 MB and a document.
BLOCK_IDS, ROW_BYTES, FILE_ROWS = 1 << 20, 1 << 20, 4


def _rows_of_ids(ranks_path: str, pattern: str):
    """Documents -> rows of kind ``tokens``, the ids of several documents with end ids between them, each followed by the
    row of kind ``ids`` that tells their ordinals and document ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(ByteBpe, ranks_path, pattern)
        held: list[bytes] = []
        names: list[str] = []
        size = first = 0

        def row() -> pa.RecordBatch:
            values = [b"\0\0".join(held), f"{first}:{','.join(names)}".encode()]
            return pa.RecordBatch.from_arrays([pa.array(["tokens", "ids"]), pa.array(values, pa.binary())], names=["kind", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(bpe.ids(str(text.as_py() or b"", "utf-8", "replace")), np.int64) + 1
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("the vocabulary doesn't fit into 16 bits")
                held.append(ids.astype("<u2").tobytes())
                names.append("" if doc_id is None else str(doc_id))
                size += len(held[-1]) + 2
                if size >= ROW_BYTES:
                    yield row()
                    first += len(held)
                    held, names, size = [], [], 0
        if held:
            yield row()

    return run


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting inside the block only."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_token_files(docs: DataFrame, path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One sequence of files for each partition of ``docs``, its documents in order, each closed by the end id, below
    ``path/kind=tokens``; beside them, from the same tasks, the documents' ids below ``path/kind=ids``.

    Spark's text writer writes a row's bytes as they are and then its line separator: two zero bytes, the end id. With a
    writer open for both kinds it keeps the order of rows.
    """
    rows = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")), _rows_of_ids(ranks_path, pattern), "kind string, ids binary")
    with _setting(docs.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        rows.select("kind", F.col("ids").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", LINE_END).option("maxRecordsPerFile", FILE_ROWS).text(path)


def _blocks(block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                rows: list[list] = [[], [], [], [], [], []]
                for block, at in enumerate(range(0, len(ids), block_ids)):
                    part = ids[at : at + block_ids]
                    ends = np.flatnonzero(part == END)
                    last = int(ends[-1]) + 1 if len(ends) else -1
                    head = int(ends[0]) if len(ends) else len(part)
                    for column, value in zip(rows, (path, block, len(part), last, head, np.diff(ends) - 1), strict=True):
                        column.append(value)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["path", "block", "n", "last", "head", "between"])

    return run


def count_tokens(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Files below ``path`` -> ``(sequence, ordinal, start, n_tokens, ended)``, a row for each document.

    ``sequence`` is the number after ``part-`` in a file's name; files of one sequence continue each other.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")
    scanned = map_arrow(files, _blocks(block_ids), "path string, block long, n long, last long, head long, between array<long>")
    name = F.element_at(F.split("path", "/"), -1)
    blocks = scanned.withColumn("sequence", F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")).withColumn("file", F.coalesce(F.regexp_extract(name, r"[-.]c(\d+)", 1).try_cast("long"), F.lit(0)))
    order = W.partitionBy("sequence").orderBy("file", "block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ends = F.when(F.col("last") > 0, F.size("between") + 1).otherwise(F.lit(0))
    scan = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    scan = scan.withColumn("start", F.coalesce(F.max(F.when(F.col("last") > 0, F.col("base") + F.col("last"))).over(before), F.lit(0)))
    scan = scan.withColumn("final", F.lead("block").over(order).isNull())
    first = F.array((F.col("base") - F.col("start") + F.col("head")).alias("x"))
    whole = scan.filter("last > 0").select("sequence", "ordinal", "start", F.posexplode(F.concat(first, "between")).alias("i", "n_tokens"), F.concat(first, "between").alias("all"))
    whole = whole.drop("all").withColumn("place", F.sum(F.col("n_tokens") + 1).over(W.partitionBy("sequence", "ordinal").orderBy("i").rowsBetween(W.unboundedPreceding, -1)))
    done = whole.select("sequence", (F.col("ordinal") + F.col("i")).alias("ordinal"), (F.col("start") + F.coalesce("place", F.lit(0))).alias("start"), "n_tokens", F.lit(True).alias("ended"))
    tail_start = F.when(F.col("last") > 0, F.col("base") + F.col("last")).otherwise(F.col("start"))
    tail = scan.filter("final").select("sequence", (F.col("ordinal") + ends).alias("ordinal"), tail_start.alias("start"), (F.col("base") + F.col("n") - tail_start).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(tail.filter("n_tokens > 0"))


def document_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(sequence, ordinal, doc_id)`` of the documents whose ids lie below ``path``."""
    rows = spark.read.option("lineSep", LINE_END).option("pathGlobFilter", "part-*").text(path)
    sequence = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    ids = rows.select(sequence.alias("sequence"), F.split_part("value", F.lit(":"), F.lit(1)).cast("long").alias("first"), F.posexplode(F.split(F.split_part("value", F.lit(":"), F.lit(2)), ",")).alias("i", "id"))
    return ids.select("sequence", (F.col("first") + F.col("i")).alias("ordinal"), F.when(F.col("id") != "", F.col("id").cast("long")).alias("doc_id"))


def count_document_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of ``docs`` and counts them: ``(doc_id, n_tokens, sequence, ordinal, start)``.

    The token files know no ids; the task that wrote a sequence wrote its documents' ids beside it. Differing counts raise an error.
    """
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tarnflow-{uuid.uuid4().hex}/tokens"
    write_token_files(docs, path, ranks_path, pattern, id_col, text_col)
    if spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long, sequence long, ordinal long, start long")
    joined = document_ids(spark, f"{path}/kind=ids").withColumn("known", F.lit(True)).join(count_tokens(spark, f"{path}/kind=tokens"), ["sequence", "ordinal"], "full")
    counts = F.when(F.col("ended") & F.col("known"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("token files and documents differ")).cast("long"))
    return joined.select("doc_id", counts.alias("n_tokens"), "sequence", "ordinal", "start")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document in the token files of all documents."""
    import public_tokenizers

    return count_document_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
