"""Stored tables: only touched buckets are written, and any write may be repeated."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnflow.sources import stores

CHUNKS = "source_id long, chunk_id long, chunk_index int, content string, embedding array<float>"


def _names(path):
    return {p.parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in Path(path, "rows").glob("bucket=*/*.parquet")}


def _chunks(spark, sources, text):
    return spark.createDataFrame([(s, 10 * s + i, i, f"{text} {s} {i}", None if i else [1.0, 2.0]) for s in sources for i in range(3)], CHUNKS)


def _found(spark, path):
    return {(r.source_id, r.chunk_index): r.content for r in stores.read_store(spark, path).collect()}


@pytest.fixture
def store(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    stores.create_store(_chunks(spark, range(40), "old"), path, "source_id", 16)
    return path


def test_untouched_buckets_keep_their_files(spark, store):
    before = _names(store)
    assert len(before) == 16
    stores.write_chunks(spark, store, "w1", _chunks(spark, [3, 7, 99], "new"))
    after = _names(store)
    touched = {f"bucket={r[0]}" for r in spark.createDataFrame([(3,), (7,), (99,)], "source_id long").select(stores._bucket("source_id", 16)).collect()}
    assert {b for b in before if after.get(b) != before[b]} == touched and len(touched) < 4
    want = {(s, i): f"{'new' if s in (3, 7, 99) else 'old'} {s} {i}" for s in [*range(40), 99] for i in range(3)}
    assert _found(spark, store) == want
    stores.write_chunks(spark, store, "w1", _chunks(spark, [3, 7, 99], "again"))  # the same write: done already
    assert _names(store) == after and _found(spark, store) == want


@pytest.mark.parametrize("lost", [False, True])
def test_a_write_that_broke_off_is_repeated(spark, store, monkeypatch, lost):
    """The second step fails at once, or after a touched bucket's old files are gone already."""

    def fail(spark, path, name):
        if lost:
            bucket = spark.read.parquet(f"{path}/staged/{name}/touched").first().bucket
            stores._delete(spark, f"{path}/rows/bucket={bucket}")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stores, "put_in_place", fail)
        with pytest.raises(RuntimeError):
            stores.write_chunks(spark, store, "w1", _chunks(spark, [3, 7], "new"))
    stores.write_chunks(spark, store, "w1", _chunks(spark, [3, 7], "new"))
    assert _found(spark, store) == {(s, i): f"{'new' if s in (3, 7) else 'old'} {s} {i}" for s in range(40) for i in range(3)}


def test_refused_and_emptied_sources(spark, store):
    stores.write_chunks(spark, store, "refused", _chunks(spark, [3, 50], "new"), overwrite=False)
    assert _found(spark, store)[3, 0] == "old 3 0" and _found(spark, store)[50, 0] == "new 50 0"
    gone = spark.createDataFrame([(5,)], "source_id long")
    stores.merge_into_store(spark, store, "gone", gone, lambda target, keys: target.join(keys, "source_id", "left_anti"))
    assert (5, 0) not in _found(spark, store) and (6, 0) in _found(spark, store)
    every = stores.read_store(spark, store).select("source_id").distinct()
    stores.merge_into_store(spark, store, "all", every, lambda target, keys: target.limit(0))
    assert _names(store) == {}


def test_embeddings(spark, store):
    results = spark.createDataFrame([(31, [5.0, 6.0]), (30, [9.0, 9.0]), (71, [1.0]), (9999, [1.0, 1.0])], "chunk_id long, new array<float>")
    before = _names(store)
    stores.write_embeddings(spark, store, "e1", results, dims=2)
    found = {r.chunk_id: r.embedding for r in stores.read_store(spark, store).collect()}
    assert found[31] == [5.0, 6.0] and found[30] == [1.0, 2.0] and found[71] is None and len(found) == 120
    assert sum(_names(store)[b] != before[b] for b in before) <= 2


def test_sources(spark, tmp_path):
    kind = "source_id long, title string, raw_content string, model_id long, devices array<struct<model_id:long,path:string>>"
    stores.create_store(spark.createDataFrame([(1, "a", "text", 1, [(1, "x")]), (2, "b", "more", None, [])], kind), f"{tmp_path}/s", "source_id", 4)
    updates = spark.createDataFrame([(1, 1, "", "new", None, [(2, "y")]), (3, 1, "c", "", 3, [])], "source_id long, seq int, " + kind.split(", ", 1)[1])
    for _ in range(2):
        stores.write_sources(spark, f"{tmp_path}/s", "u1", updates)
    got = {r.source_id: (r.title, r.raw_content, r.model_id, [tuple(x) for x in r.devices or []]) for r in stores.read_store(spark, f"{tmp_path}/s").collect()}
    assert got[1] == ("a", "new", 1, [(1, "x"), (2, "y")]) and got[2] == ("b", "more", None, []) and got[3][0] == "c"
    assert stores.read_store(spark, f"{tmp_path}/s").filter(F.col("source_id") == 1).count() == 1
