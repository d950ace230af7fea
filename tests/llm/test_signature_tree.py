import random

import numpy as np
import pytest

from tarnflow.llm import signature_tree
from tarnflow.llm.shingles import shingle_sets
from tests.llm.test_near_dedup import brute
from tests.oracle import assert_same


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def hard_rows():
    """Chains of near copies, a passage and a license in many texts, copies, short, empty and null texts."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, license = [word() for _ in range(60)], [word() for _ in range(200)]
    rows = []
    for _ in range(30):
        text = [word() for _ in range(rng.choice([20, 60, 200, 400]))]
        for _ in range(rng.choice([1, 2, 8])):
            rows.append(" ".join(text))
            text = edited(rng, text, rng.choice([0, 1, 2, len(text) // 30]))
    hot = [word() for _ in range(150)]
    rows += [" ".join(edited(rng, hot, rng.choice([0, 1, 2, 3]))) for _ in range(150)]
    rows += [" ".join([word() for _ in range(rng.choice([10, 100]))] + passage + [word() for _ in range(rng.choice([5, 50]))]) for _ in range(60)]
    rows += [" ".join(license + [word() for _ in range(rng.choice([0, 3, 8, 20, 300]))]) for _ in range(80)]
    rows += ["", None, " \t ", "one", "ONE", "one two", "one two three", "One  two\nthree", "a b c d e f g h i j k l", "a b c d e f g h i j k l m"] + [" ".join(word() for _ in range(30_000))] * 2
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_against_brute_force(spark, hard_rows, k, percent):
    docs = spark.createDataFrame(hard_rows, "doc_id long, text string").repartition(7)
    assert groups(signature_tree.similar_groups(docs, k, percent)) == brute(hard_rows, k, percent)


def test_small_blocks_and_shuffles(spark, hard_rows, monkeypatch):
    for name, value in (("BLOCK_MEMBERS", 5), ("BROADCAST_PLACES", 0), ("BROADCAST_IDS", 0), ("FIRST", 1), ("FREQUENT", 10), ("MOST_FREQUENT", 50)):
        monkeypatch.setattr(signature_tree, name, value)
    docs = spark.createDataFrame(hard_rows, "doc_id long, text string")
    assert groups(signature_tree.similar_groups(docs, 3, 90)) == brute(hard_rows, 3, 90)


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3, 90)
    out = signature_tree.op13_signature_tree(spark, sf_dir)
    assert out.dtypes[:3] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert groups(out) == want


def test_oracle(spark, sf_dir):
    assert assert_same(signature_tree.op13_signature_tree(spark, sf_dir), signature_tree.ORACLES["op13_signature_tree"], sf_dir)


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, a), (2, a + " x"), (3, b), (4, b + " y"), (2, b), (5, ""), (5, None), (None, a), (1, a)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, component long, key string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in signature_tree.similar_groups(docs, 3, 90).collect())
    assert got == sorted([(1, 78, 1), (2, 79, 1), (3, 78, 1), (4, 79, 1), (2, 78, 1), (5, 0, 5), (5, 0, 5), (-1, 78, -1), (1, 78, 1)])


def test_empty_table(spark):
    assert signature_tree.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_rule_out_no_link():
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 30, 66, 300]))]
        texts += [" ".join(edited(rng, words, rng.choice([0, 1, 2]))).encode() for _ in range(4)]
        texts.append(" ".join(words + ["x"] * rng.choice([0, 1, 30])).encode())
    sets = shingle_sets(texts, 3)
    sizes, bitmaps, n = [len(s) for s in sets], [signature_tree.signature(s) for s in sets], len(sets)
    for percent in (30, 50, 80, 90, 100):
        alone = {tuple(sorted(p)) for p in signature_tree.candidates(sizes, bitmaps, list(range(n)), [True] * n, percent)}
        sides = {tuple(sorted(p)) for p in signature_tree.candidates(sizes, bitmaps, list(range(n)), [i < 50 for i in range(n)], percent)}
        grouped = {tuple(sorted(p)) for p in signature_tree.candidates(sizes, bitmaps, [i // 10 for i in range(n)], [True] * n, percent)}
        for i in range(n):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if shared and 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                    assert (j, i) in alone
                    assert ((j, i) in sides) == (j < 50 <= i) and ((j, i) in grouped) == (i // 10 != j // 10)
    assert len(list(signature_tree.candidates(sizes, bitmaps, list(range(n)), [True] * n, 90))) < n * n / 20
    assert (signature_tree.folded(bitmaps[0], 1) == np.bitwise_or.reduce(bitmaps[0])).all()


def test_difference_prefixes_miss_no_link():
    rng = random.Random(11)
    for percent in (30, 60, 90, 100):
        pivot = set(rng.sample(range(400), 60))
        sets = [pivot]
        for _ in range(250):
            base = set(rng.choice(sets))
            for _ in range(rng.choice([0, 1, 3, 6, 20])):
                base ^= {rng.randrange(400)}
            sets.append(base | {1000})
        linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
        apart, beside, near = [], [], []
        for s in sets:
            half, long = signature_tree.difference_prefixes(len(s), len(pivot), len(s ^ pivot), percent)
            ordered = sorted(s ^ pivot, key=lambda x: (x in pivot, x))
            near.append(linked(s, pivot))
            apart.append(set(ordered[:half]))
            beside.append(set(ordered[: half if near[-1] else long]))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a != b and linked(a, b) and not (near[i] and near[j]):
                    assert beside[i] & beside[j] if near[i] or near[j] else apart[i] & apart[j]


def near_copies(n):
    """Near copies of one text, most of them not linked, some linked with one another only."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [base]
    while len(rows) < n:
        text = edited(rng, base, rng.choice([1, 3, 3, 4, 4, 8]))
        rows += [text, edited(rng, text, 1)] if rng.random() < 0.2 else [text]
    return list(enumerate(" ".join(x) for x in rows[:n]))


def test_near_copies_take_rows_in_proportion(spark, monkeypatch):
    """A bucket of near copies was cut to a grid of blocks, with rows by the square of its members."""
    monkeypatch.setattr(signature_tree, "BLOCK_MEMBERS", 32)
    placed, once = [], signature_tree._blocks_once
    monkeypatch.setattr(signature_tree, "_blocks_once", lambda df, keys: placed.append(df.count()) or once(df, keys))
    for n in (200, 600):
        rows = near_copies(n)
        placed.clear()
        assert groups(signature_tree.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)) == brute(rows, 3, 90)
        assert sum(placed) < 6 * n


def test_pivot_with_several_texts(spark, monkeypatch):
    monkeypatch.setattr(signature_tree, "BLOCK_MEMBERS", 8)
    rng = random.Random(6)
    rows = near_copies(80)
    strays = [text for _, text in near_copies(160)[80:]]
    rows += [(i, text) for i, text in zip([0, 0, 1, 2, 3, 3], strays, strict=False)] + [(100 + i, " ".join(edited(rng, x.split(), 1))) for i, x in enumerate(strays[:6])]
    # An id with several texts links the groups of each.
    apart = [(1000 + i, text) for i, (_, text) in enumerate(rows)]
    want = {r: c for r, (_, c) in brute(apart, 3, 90).items()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, (doc_id, _) in enumerate(rows):
        x, y = root(doc_id), root(("class", want[1000 + i]))
        if x != y:
            parent[y] = x
    members = {}
    for doc_id, _ in rows:
        members.setdefault(root(doc_id), set()).add(doc_id)
    got = {r.doc_id: r.component_id for r in signature_tree.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {d: min(members[root(d)]) for d, _ in rows}
