"""Greedy batches in parallel against the plain loop, over many blocks and groups of them."""

import random

import numpy as np
import pytest

from tarnflow.operators import batching


def plain(sizes, max_items, max_size):
    out, number, items, size = [], 0, 0, 0
    for i, n in enumerate(sizes):
        if i and (items >= max_items or size + n > max_size):
            number, items, size = number + 1, 0, 0
        items, size = items + 1, size + n
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_jumps_against_the_loop(seed):
    rng = random.Random(seed)
    max_items, max_size = rng.choice([1, 3, 10]), rng.choice([0, 5, 40])
    sizes = [rng.choice([0, 1, 3, 9, 100]) for _ in range(rng.choice([1, 9, 60]))]
    own = rng.randint(1, len(sizes))
    to, counts = batching.jump_table(np.array(sizes), own, min(own, max_items), max_items, max_size)
    for entry, (exit, n) in enumerate(zip(to, counts, strict=True)):
        numbers = plain(sizes[entry:], max_items, max_size)
        starts = [entry + i for i in range(len(numbers)) if i == 0 or numbers[i] != numbers[i - 1]] + [len(sizes)]
        assert own + exit == min(s for s in starts if s >= own)
        assert n == sum(s < own for s in starts)


@pytest.mark.parametrize(("block_rows", "group", "broadcast"), [(1, 2, 200_000), (50, 3, 0), (100_000, 64, 200_000)])
def test_families_of_all_sizes(spark, monkeypatch, block_rows, group, broadcast):
    """One family holds nearly all rows; a null family is one too."""
    monkeypatch.setattr(batching, "GROUP_TABLES", group)
    monkeypatch.setattr(batching, "BROADCAST_ROWS", broadcast)
    rng = random.Random(block_rows)
    families = {"hot": 1500, "b": 1, "c": 33, None: 40}
    rows = [(f, i % 700, 10_000 * k + i, rng.choice([0, 2, 5, None, 30, 300])) for k, (f, n) in enumerate(families.items()) for i in range(n)]
    table = spark.createDataFrame(rows, "family_id string, position int, chunk_id long, bytes int").repartition(6)
    got = {r.chunk_id: (r.family_id, r.batch_no) for r in batching.pack_embedding_batches(table, 9, 100, "bytes", block_rows).collect()}
    want = {}
    for f in families:
        own = sorted((p, c, n or 0) for name, p, c, n in rows if name == f)
        want |= {c: (f, b) for (_, c, _), b in zip(own, plain([n for *_, n in own], 9, 100), strict=True)}
    assert got == want


def test_no_task_holds_more_than_its_share(spark):
    """All rows of one family: after the pack every partition has about the rows of its blocks."""
    rows = spark.range(40_000).selectExpr("'one' AS family_id", "id AS position", "id AS chunk_id", "id % 50 AS bytes")
    out = batching.pack_embedding_batches(rows, 20, 400, "bytes", 1_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = out.groupBy(out.family_id).count().collect()
        shares = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes[0]["count"] == 40_000
    assert len(shares) == 4 and max(shares) < 20_000


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], "family_id string, position int, chunk_id long, bytes int")
    assert batching.pack_embedding_batches(empty).collect() == []
