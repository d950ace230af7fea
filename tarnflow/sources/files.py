"""Files in and out: texts, guide bundles, chunk documents, embedding requests and results, ledgers, tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count

CHUNK_SCHEMA = "metadata struct<source_id:string,total_chunks:int,total_chars:bigint,total_words:bigint,total_tokens:bigint,embeddable_chunks:int,reference_chunks:int>, chunks array<struct<chunk_index:int,content:string,heading:string,token_count:int,content_type:string>>"
BUNDLE_SCHEMA = (
    "guides array<struct<source_id:string,title:string,raw_content:string,model_id:string,word_count:int>>, families array<struct<family_id:string,name:string,description:string>>, "
    "devices array<struct<model_id:string,family_id:string,manufacturer:string,model_name:string,model_number:string>>, applicable_devices_updates array<struct<guide_uuid:string,applicable_device_info:struct<model_id:string,device_path:string>>>"
)


def read_source_texts(spark: SparkSession, glob: str) -> DataFrame:
    """One row for each file, its whole text as a value."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_content"))


def read_guide_bundle(spark: SparkSession, path: str, one_each: bool = True) -> dict[str, DataFrame]:
    """Bundles, one in each file or (``one_each`` false) one in each line, which Spark can split."""
    bundle = spark.read.schema(BUNDLE_SCHEMA).json(path, multiLine=one_each)
    return {name: bundle.select(F.inline(name)) for name in ("guides", "families", "devices", "applicable_devices_updates")}


def chunk_documents_as_json(chunks: DataFrame) -> DataFrame:
    """``chunks(source_id, chunk_index, content, heading, token_count, content_type)`` -> one row for each source in the file's shape."""
    narrative = F.count_if(F.col("content_type") == "narrative").cast("int")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content", "heading", "token_count", "content_type")))
    rows = chunks.groupBy(F.col("source_id").cast("string").alias("source_id")).agg(
        F.count("*").cast("int").alias("n"), F.sum(F.length("content")).alias("chars"), F.sum(word_count(F.col("content"))).alias("words"), F.sum("token_count").alias("tokens"), narrative.alias("good"), parts.alias("chunks")
    )
    head = F.struct("source_id", F.col("n").alias("total_chunks"), F.col("chars").alias("total_chars"), F.col("words").alias("total_words"), F.col("tokens").alias("total_tokens"), F.col("good").alias("embeddable_chunks"), (F.col("n") - F.col("good")).alias("reference_chunks"))
    return rows.select(head.alias("metadata"), "chunks")


def write_chunk_documents(chunks: DataFrame, path: str) -> None:
    chunk_documents_as_json(chunks).write.json(path)


def read_chunk_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).json(path).select("metadata.source_id", F.inline("chunks"))


def embedding_requests(chunks: DataFrame, model: str) -> DataFrame:
    """``chunks(chunk_id, content[, batch_no])`` -> JSON request lines."""
    body = F.struct(F.lit(model).alias("model"), F.col("content").alias("input"), F.lit("float").alias("encoding_format"))
    line = F.to_json(F.struct(F.col("chunk_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")))
    return chunks.select(*[c for c in chunks.columns if c == "batch_no"], line.alias("value"))


def write_embedding_requests(chunks: DataFrame, path: str, model: str) -> None:
    """One folder of request lines for each batch."""
    embedding_requests(chunks, model).write.partitionBy("batch_no").text(path)


def read_embedding_results(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Result lines -> ``(line_no, chunk_id, embedding, error)``; a bad line is a row with the first fault found, never an exception."""
    rows = lines.filter(F.trim(F.col(line_col)) != "").withColumn("__v", F.try_parse_json(line_col))
    text = lambda p: F.try_variant_get("__v", p, "string")
    any_of = lambda p: F.try_variant_get("__v", p, "variant")
    missing = lambda p: any_of(p).isNull() | F.coalesce(F.is_variant_null(any_of(p)), F.lit(False))
    vector = F.try_variant_get("__v", "$.response.body.data[0].embedding", "array<float>")
    status = F.try_variant_get("__v", "$.response.status_code", "int")
    error = (
        F.when(F.col("__v").isNull(), "invalid json").when(missing("$.custom_id"), "missing custom_id").when(~missing("$.error") & missing("$.response"), F.concat(F.lit("error: "), F.coalesce(text("$.error.message"), text("$.error"), F.lit("unknown"))))
        .when(missing("$.response"), "missing response").when(F.coalesce(status, F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(status.cast("string"), F.lit("none")))).when(vector.isNull(), "embedding is no list")
    )
    out = rows.select(*[c for c in lines.columns if c != line_col], text("$.custom_id").alias("chunk_id"), error.alias("__error"), vector.alias("__vector"))
    return out.select(*[c for c in out.columns if not c.startswith("__")], F.when(F.col("__error").isNull(), F.col("__vector")).alias("embedding"), F.left("__error", F.lit(2000)).alias("error"))


def write_failures_tsv(df: DataFrame, path: str) -> None:
    df.filter("error IS NOT NULL").select("chunk_id", "error").write.option("sep", "\t").csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.withColumn("failed_devices", F.from_json("failed_devices", "array<string>"))


def failure_report(ledger: DataFrame) -> DataFrame:
    return ledger.filter((F.col("status") == "failed") | (F.coalesce(F.size("failed_devices"), F.lit(0)) > 0))


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.withColumn("failed_devices", F.to_json("failed_devices")).write.option("header", True).option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str, jdbc: dict[str, str] | None = None, key: str | None = None, partitions: int = 16) -> DataFrame:
    """Parquet at ``path``, or where ``jdbc`` options (url, dbtable, driver, ...) are given a relational table.

    With a numeric or date ``key`` the table is read in ``partitions`` ranges at once: their bounds are asked of the source, as
    its least and greatest key, and rows without a key are in the first. Ranges are of equal width; the key's index should
    serve them.
    """
    if not jdbc:
        return spark.read.parquet(path)
    if key is None:
        return spark.read.format("jdbc").options(**jdbc).load()
    ends = {**jdbc, "query": f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {jdbc['dbtable']}"}
    del ends["dbtable"]
    row = spark.read.format("jdbc").options(**ends).load().first()
    low, high = row[0], row[1]
    if low is None or low == high:
        return spark.read.format("jdbc").options(**jdbc).load()
    where = _ranges(key, low, high, partitions)
    more = {k: v for k, v in jdbc.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(jdbc["url"], jdbc["dbtable"], predicates=where, properties=more)


def _ranges(key: str, low, high, partitions: int) -> list[str]:
    """Conditions of ranges that hold every row once."""
    dated = isinstance(low, datetime.date)
    first, last = (low.toordinal(), high.toordinal()) if dated else (int(low), int(high) + (int(high) != high))
    cuts = sorted({first + (last - first) * i // partitions for i in range(1, partitions)} - {first})
    value = (lambda x: f"DATE('{datetime.date.fromordinal(x)}')") if dated else str
    bounds = [f"{key} >= {value(a)} AND {key} < {value(b)}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{key} < {value(cuts[0])} OR {key} IS NULL", *bounds, f"{key} >= {value(cuts[-1])}"] if cuts else ["1 = 1"]


def write_table(df: DataFrame, path: str, mode: str = "error", jdbc: dict[str, str] | None = None) -> None:
    """Parquet at ``path``, or where ``jdbc`` options are given a relational table, staged.

    All tasks write to a table beside it, ``<dbtable>_staged``. When they are done, one transaction of the database moves the rows
    (``overwrite`` empties the table first), so readers see all of a write or nothing, and a write that failed may be done
    again. The table must exist, with columns of the same names.
    """
    if not jdbc:
        df.write.mode(mode).parquet(path)
        return
    spark, name = df.sparkSession, jdbc["dbtable"]
    df.write.format("jdbc").options(**{**jdbc, "dbtable": f"{name}_staged"}).mode("overwrite").save()
    columns = ", ".join(f'"{c}"' if c != c.upper() else c for c in df.columns)
    steps = ([f"DELETE FROM {name}"] if mode == "overwrite" else []) + [f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {name}_staged"]
    connection = spark._jvm.java.sql.DriverManager.getConnection(jdbc["url"])
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for step in steps:
            statement.executeUpdate(step)
        connection.commit()
        statement.executeUpdate(f"DROP TABLE {name}_staged")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Numbers of lines in the order of the files' partitions; gaps between partitions."""
    return lines.withColumn("line_no", F.monotonically_increasing_id())


