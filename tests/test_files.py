"""Files and tables in and out: what is read back is what was written."""

import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnflow.operators.chunks import chunk_documents
from tarnflow.plans import catalogs
from tarnflow.sources import files
from tarnflow.sources.adapters import view
from tarnflow.streaming import jobs

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("derby")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{folder}/derby.log")
    spark._jvm.java.lang.Class.forName(DERBY["driver"])
    url = f"jdbc:derby:{folder}/db;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for name in ("SOURCES", "EMPTIES"):
        connection.createStatement().execute(f'CREATE TABLE {name} ("id" BIGINT, "day" DATE, "score" DOUBLE, "text" CLOB)')
    connection.close()
    return url


def _rows(spark, n):
    day = F.date_add(F.lit("2024-02-01").cast("date"), (F.col("id") % 400).cast("int"))
    return spark.range(n).select(F.when(F.col("id") % 50 != 7, F.col("id") * 3 - 100).alias("id"), F.when(F.col("id") % 40 != 3, day).alias("day"), (F.col("id") / 7).alias("score"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))


def _set(df):
    return sorted(((r.id, r.day, round(r.score, 9), r.text) for r in df.collect()), key=str)


def test_relational_tables_in_parts(spark, database, tmp_path):
    """Written by staged parallel writes, read in ranges of a number and of a date; equal to Parquet."""
    rows = _rows(spark, 500)
    files.write_table(rows, f"{tmp_path}/p")
    options = {"url": database, "dbtable": "SOURCES", **DERBY}
    files.write_table(rows.repartition(4), "", "append", options)
    want = _set(files.read_table(spark, f"{tmp_path}/p"))
    for key in ('"id"', '"day"', '"score"'):
        found = files.read_table(spark, "", options, key, 6)
        assert found.rdd.getNumPartitions() == 6
        assert _set(found) == want
        assert sum(n > 0 for n in found.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()) == 6
    assert _set(files.read_table(spark, "", options)) == want
    files.write_table(rows.limit(9), "", "overwrite", options)
    assert files.read_table(spark, "", options, '"id"').count() == 9


def test_a_failed_relational_write_leaves_the_table(spark, database):
    options = {"url": database, "dbtable": "SOURCES", **DERBY}
    files.write_table(_rows(spark, 5), "", "overwrite", options)
    with pytest.raises(Exception, match="."):
        files.write_table(_rows(spark, 3).withColumnRenamed("text", "other"), "", "overwrite", options)
    assert files.read_table(spark, "", options).count() == 5


def test_an_empty_relational_table(spark, database):
    options = {"url": database, "dbtable": "EMPTIES", **DERBY}
    assert files.read_table(spark, "", options, '"id"').collect() == []
    files.write_table(_rows(spark, 1), "", "append", options)
    assert files.read_table(spark, "", options, '"id"').count() == 1


@pytest.mark.parametrize(("low", "high", "n"), [(0, 1, 8), (-5, 5, 3), (0, 10**15, 7), (0.5, 2.25, 4), (datetime.date(2024, 1, 1), datetime.date(2024, 1, 3), 9)])
def test_ranges_hold_every_key_once(spark, low, high, n):
    where = files._ranges("k", low, high, n)
    assert 1 <= len(where) <= n
    keys = [low + datetime.timedelta(days=i) for i in range(3)] if isinstance(low, datetime.date) else [low + (high - low) * i / 10 for i in range(11)] if isinstance(low, float) else [low + (high - low) * i // 10 for i in range(11)]
    table = spark.createDataFrame([(k,) for k in [*keys, None]], "k date" if isinstance(low, datetime.date) else "k double" if isinstance(low, float) else "k long")
    for row in table.select("k", *[F.coalesce(F.expr(w), F.lit(False)).alias(f"w{i}") for i, w in enumerate(where)]).collect():
        assert sum(row[1:]) == 1, row


def test_chunk_documents_are_read_back(spark, sf_dir, tmp_path):
    chunks = chunk_documents(view(spark, sf_dir, "v_sources"), id_col="source_id").withColumnRenamed("doc_id", "source_id")
    files.write_chunk_documents(chunks, f"{tmp_path}/c")
    columns = ["source_id", "chunk_index", "content", "heading", "token_count", "content_type"]
    want = sorted(((str(r.source_id), *r[1:]) for r in chunks.select(columns).collect()), key=str)
    assert sorted((tuple(r) for r in files.read_chunk_documents(spark, f"{tmp_path}/c").select(columns).collect()), key=str) == want and want
    documents = [json.loads(line) for p in Path(tmp_path, "c").glob("*.json") for line in p.read_text().splitlines()]
    assert len(documents) == len({d["metadata"]["source_id"] for d in documents}) == len({w[0] for w in want})
    for d in documents:
        own = d["chunks"]
        assert [c["chunk_index"] for c in own] == list(range(len(own)))
        narrative = sum(c["content_type"] == "narrative" for c in own)
        assert d["metadata"] == {
            "source_id": d["metadata"]["source_id"], "total_chunks": len(own), "total_chars": sum(len(c["content"]) for c in own), "total_words": sum(len(c["content"].split()) for c in own),
            "total_tokens": sum(c["token_count"] for c in own), "embeddable_chunks": narrative, "reference_chunks": len(own) - narrative,
        }


def test_new_texts_are_chunked_as_they_come(spark, sf_dir, tmp_path):
    """The newest text of each document stands, by its time; a trigger that runs again changes nothing."""
    kind = "doc_id long, raw_content string, updated_at int"
    texts = {i: "# Title\n" + f"Words of document {i} that go on for a while. " * 30 for i in range(6)}
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: jobs.auto_chunk_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    found = lambda: sorted((r.doc_id, r.chunk_index, r.content) for r in jobs.current_chunks(spark, f"{tmp_path}/out").collect())

    def want(rows):
        return sorted((r.doc_id, r.chunk_index, r.content) for r in chunk_documents(spark.createDataFrame(rows, kind)).collect())

    feed([(i, t, 1) for i, t in texts.items()])
    feed([(0, "# New\n" + "An entirely new text of this document. " * 20, 5), (1, "too old", 0), (2, None, 6)])
    run()
    newest = [(0, "# New\n" + "An entirely new text of this document. " * 20, 5), *[(i, texts[i], 1) for i in (1, 3, 4, 5)]]
    assert found() == want(newest) and {x[0] for x in found()} == {0, 1, 3, 4, 5}
    last = max(Path(tmp_path, "checkpoint", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    before = found()
    run()  # the last trigger once more
    assert found() == before


def test_source_texts_are_written_in_files_of_bounded_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalogs, "_FILE_BYTES", 50_000, raising=False)
    plain, sizes = files.read_source_texts, []

    def read(session, glob):
        sizes.extend(r.n for r in plain(session, glob).select(F.octet_length("raw_content").alias("n")).collect())
        return plain(session, glob)

    monkeypatch.setattr(files, "read_source_texts", read)
    found = catalogs.QUERIES["read_source_texts"](spark, sf_dir).first()["chars"]
    assert len(sizes) > 8 and max(sizes) < 100_000
    assert found == view(spark, sf_dir, "v_sources").agg(F.sum(F.length(F.regexp_replace("raw_content", r"\s+", " ")))).first()[0]
