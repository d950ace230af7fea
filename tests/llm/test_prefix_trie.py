import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnflow.llm import prefix_trie
from tests.oracle import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(r)] for c, r in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def hard_rows():
    rng = random.Random(3)
    rows = []
    for c in range(-30, 400):
        if c % 20 == 0 and c % 60 == 0:
            continue  # some blocks have no base
        said = [(rng.choice(["user", "assistant", None, ""]), rng.choice(["one two", "three\x0bfour  five", "", None, " \t", "x" * 9])) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
        if c % 3 == 0:
            said = [("user", "the very same start"), ("assistant", "ok")] + said
        rows += [(c, rng.choice([i, i, None, 2]), *x) for i, x in enumerate(said)]
    rows += [(1000 + i, t, "user" if t % 2 == 0 else "assistant", f"line {t} of the hot one") for i in range(150) for t in range(8)]
    rows += [(2000 + i, t, "user", f"turn {t // 2}") for i in range(0, 40, 20) for t in range(700)]
    rows += [(3000, 0, "user", "long " * 100_000), (3020, 0, "user", "long " * 100_000), (None, 0, "user", "lost"), *[(5, None, "user", "again")] * 3]
    return rows


@pytest.mark.parametrize("shard_turns", [1, 100, 100_000])
def test_against_brute_force(spark, hard_rows, shard_turns):
    table = spark.createDataFrame(hard_rows, SCHEMA).repartition(5)
    assert found(prefix_trie.conversation_trie(table, shard_turns)) == brute(hard_rows)


def test_nodes_beyond_a_broadcast(spark, hard_rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(hard_rows, SCHEMA), 50)) == brute(hard_rows)


def test_oracle(spark, sf_dir):
    assert assert_same(prefix_trie.op11_prefix_trie(spark, sf_dir), prefix_trie.ORACLES["op11_prefix_trie"], sf_dir)


def test_registered_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(prefix_trie.op11_prefix_trie(spark, sf_dir)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi")]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", digest long, shard string")
    assert found(prefix_trie.conversation_trie(table)) == brute(rows)


def test_slots_are_minimal_and_checked():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        digests = rng.integers(0, 2**63, (n, 2), dtype=np.uint64)
        slots = prefix_trie.SlotTable(digests)
        assert sorted(slots.slots(digests).tolist()) == list(range(n))
        assert (slots.slots(rng.integers(0, 2**63, (500, 2), dtype=np.uint64)) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        prefix_trie.SlotTable(np.zeros((2, 2), np.uint64))
