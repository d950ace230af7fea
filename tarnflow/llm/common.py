"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds in numpy form at once; a longer single text is a block of its own.
BLOCK_BYTES = 2_000_000

#: Rows of two numbers that a broadcast may hold: 16 bytes each, 32 MB at most. More are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

#: The white space of the word rule ``[^\x20\x09-\x0D]+``, as SQL string and as Java character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's; a local one only where driver and executors are
    one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tarnflow-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/tarnflow-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and broadcasts of finished steps now; its cleaner waits for the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a frame of ``materialize`` once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches that long texts can't make larger than memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(function, schema)


def blocks(texts: Iterable[bytes], limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts in groups of about ``limit`` bytes."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes, a null as no bytes."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def drop_rows(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text are those of a row of ``judged(doc_id, text_hash)``; null ids and texts match."""
    own_id, own_hash = fresh(docs, "__id", "__hash")
    out = materialize(judged.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct(), "dropped")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & F.xxhash64(F.col(text_col).cast("string")).eqNullSafe(F.col(own_hash))
    return docs.join(F.broadcast(out) if is_small(out, BROADCAST_ROWS) else out, same, "left_anti")
