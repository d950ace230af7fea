"""Exact and approximate top-k: blocks, the grid of blocks, and the stored index."""

import random

import numpy as np
import pytest

from tarnflow.operators import retrieval as R
from tarnflow.sources.adapters import view

TOP = "query_id long, user_id long, embedding array<float>"


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.similarity, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    """Vectors with ties, null and zero ones; owned and shared sources."""
    rng = random.Random(8)
    vector = lambda: [float(rng.choice([0, 1, 2, -1])) for _ in range(4)]
    chunks = [(i, i // 5, None if i % 17 == 0 else vector()) for i in range(600)]
    owners = {i: None if i % 3 else i % 4 for i in range(120)}
    queries = [(i, i % 5, None if i == 3 else [0.0] * 4 if i == 4 else vector()) for i in range(90)]
    frames = spark.createDataFrame(queries, TOP), spark.createDataFrame(chunks, "chunk_id long, source_id long, embedding array<float>").repartition(5), spark.createDataFrame(list(owners.items()), "source_id long, user_id long")
    want = []
    for q, user, v in queries:
        if v is None or not any(v):
            continue
        scored = []
        for c, source, w in chunks:
            if w is not None and any(w) and owners[source] in (None, user):
                s = float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
                if round(s, 9) > 0.5:
                    scored.append((-round(s, 9), c))
        want += [(q, r, c, round(-s, 6)) for r, (s, c) in enumerate(sorted(scored)[:4], 1)]
    return frames, sorted(want)


@pytest.mark.parametrize(("vectors", "broadcast", "grid"), [(1000, 10, 8), (7, 100, 8), (7, 0, 2), (1000, 0, 8), (3, 0, 1)])
def test_exact_by_broadcast_and_by_grid(made, monkeypatch, vectors, broadcast, grid):
    for name, value in (("BLOCK_VECTORS", vectors), ("BROADCAST_BLOCKS", broadcast), ("GRID_BLOCKS", grid)):
        monkeypatch.setattr(R, name, value)
    frames, want = made
    got = rows_of(R.cosine_top_k(*frames, 4, 0.5))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])
    plan = R.cosine_top_k(*frames, 4, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_the_grid_equals_the_broadcast(spark, sf_dir, monkeypatch):
    views = [view(spark, sf_dir, n) for n in ("v_queries", "v_chunks", "v_sources")]
    for op, args in ((R.cosine_top_k, (10, 0.6)), (R.cosine_top_k_soft, (10, 0.4)), (R.cosine_top_k_scoped, (4,))):
        want = rows_of(op(*views, *args))
        with monkeypatch.context() as m:
            m.setattr(R, "BROADCAST_BLOCKS", 0)
            m.setattr(R, "BLOCK_VECTORS", 50)
            assert rows_of(op(*views, *args)) == want


def test_all_cells_are_exact(made, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "BLOCK_VECTORS", 9)
    frames, want = made
    R.build_index(*frames[1:], f"{tmp_path}/i", cells=6)
    got = rows_of(R.search_index(frames[0], f"{tmp_path}/i", 4, 0.5, nprobe=6))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_index_without_vectors(spark, made, tmp_path):
    frames, _ = made
    R.build_index(frames[1].limit(0), frames[2], f"{tmp_path}/i")
    assert R.search_index(frames[0], f"{tmp_path}/i").collect() == []
    assert R.cosine_top_k(frames[0], frames[1].limit(0), frames[2]).collect() == []


def test_ann_recall_on_every_query(spark, tmp_path):
    """At its own setting, 8 of 50 cells, against the exact search over the whole table: 0.9 over all ids divisible by 20. One index
    serves many searches, and few queries read few folders."""
    views = [view(spark, "/root/testdata/sf0.1", n) for n in ("v_queries", "v_chunks", "v_sources")]
    R.build_index(*views[1:], f"{tmp_path}/i")
    exact = {(r.query_id, r.chunk_id) for r in R.cosine_top_k(*views, 10, 0.6).collect()}
    near = {(r.query_id, r.chunk_id) for r in R.search_index(views[0], f"{tmp_path}/i", 10, 0.6).collect()}
    assert len(exact) > 50 and near <= exact and len(near) >= 0.9 * len(exact), (len(exact), len(near))
    one = R.search_index(views[0].filter("query_id = 0"), f"{tmp_path}/i", 10, 0.6)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan, plan
    files = spark.read.parquet(f"{tmp_path}/i/cells")
    assert files.select("cell").distinct().count() == 50 and {(r.query_id, r.chunk_id) for r in one.collect()} <= exact
