"""Keyed tables in a folder: Parquet in buckets of a key's hash. A write makes the touched buckets anew and leaves the others' files.

A write has a name and two steps. First the new rows of all touched buckets are put beside the table, which nobody reads yet;
then they take the buckets' places, all of them by dynamic partition overwrite. Where the second step broke off, the
same write done again finds its staged rows and puts them in place, however far the first attempt had come; once done, it does
nothing. So a write may be repeated after any failure. Writes to one table must come one after another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as M

#: Files of a bucket, so that one with a very frequent key isn't one task's work.
FILES_PER_BUCKET = 4
BUCKET = "bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _write(rows: DataFrame, path: str) -> None:
    spread = rows.withColumn("__file", F.spark_partition_id() % FILES_PER_BUCKET).repartition(BUCKET, "__file").drop("__file")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create_store(rows: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """A new table. Its key and number of buckets are kept with it."""
    spark = rows.sparkSession
    _write(rows.withColumn(BUCKET, _bucket(key, buckets)), f"{path}/rows")
    spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).drop(BUCKET)


def merge_into_store(spark: SparkSession, path: str, name: str, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """The write ``name``: ``merge(target, updates)`` over the buckets of the ``updates``' keys. Only these buckets are read."""
    staged, done = f"{path}/staged/{name}", f"{path}/done/{name}"
    if _exists(spark, done):
        return
    if not _exists(spark, f"{staged}/touched/_SUCCESS"):
        _delete(spark, staged)
        about = spark.read.parquet(f"{path}/about").first()
        touched = [r[0] for r in updates.select(_bucket(about.key, about.buckets)).distinct().collect()]  # as many numbers as buckets
        target = _rows(spark, path)
        new = merge(target.filter(F.col(BUCKET).isin(touched)).drop(BUCKET), updates).select(*[c for c in target.columns if c != BUCKET])
        _write(new.withColumn(BUCKET, _bucket(about.key, about.buckets)), f"{staged}/rows")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{staged}/touched")
    put_in_place(spark, path, name)


def put_in_place(spark: SparkSession, path: str, name: str) -> None:
    """The second step of a write; may be repeated."""
    staged, done = f"{path}/staged/{name}", f"{path}/done/{name}"
    target = _rows(spark, path)
    for r in spark.read.parquet(f"{staged}/touched").collect():
        if not _exists(spark, f"{staged}/rows/{BUCKET}={r.bucket}"):  # nothing is left in it
            _delete(spark, f"{path}/rows/{BUCKET}={r.bucket}")
    _write(spark.read.schema(target.schema).parquet(f"{staged}/rows"), f"{path}/rows")
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(done)
    _delete(spark, staged)


def write_sources(spark: SparkSession, path: str, name: str, updates: DataFrame) -> None:
    """``upsert_sources`` on a stored table with the key ``source_id``."""
    merge_into_store(spark, path, name, updates, M.upsert_sources)


def write_chunks(spark: SparkSession, path: str, name: str, new_chunks: DataFrame, overwrite: bool = True) -> None:
    """``replace_source_chunks`` on a stored table with the key ``source_id``."""
    merge_into_store(spark, path, name, new_chunks, lambda target, new: M.replace_source_chunks(target, new, overwrite))


def write_embeddings(spark: SparkSession, path: str, name: str, results: DataFrame, dims: int = 1536, only_if_null: bool = True) -> None:
    """``apply_embeddings`` on a stored table with the key ``source_id``: results find their chunks' sources first, by ids alone."""
    known = results.join(read_store(spark, path).select("chunk_id", "source_id"), "chunk_id")
    merge_into_store(spark, path, name, known, lambda target, new: M.apply_embeddings(target, new.select("chunk_id", "new"), dims, only_if_null))
