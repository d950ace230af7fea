import re
from collections import Counter, defaultdict

import pytest

from tarnflow.llm import components, near_dedup
from tarnflow.llm.shingles import shingle_sets
from tests.oracle import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """Groups from all pairs, found through each set's rarest shingles (exact)."""
    sets = {i: set_of(t, k) for i, t in rows}
    count = Counter(x for s in sets.values() for x in s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(list)
    for i, s in sorted(sets.items()):
        order = sorted(s, key=lambda x: (count[x], x))
        near = set()
        for x in order[: len(s) - (-(-len(s) * percent // 100)) + 1]:
            near.update(index[x])
            index[x].append(i)
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, sf_dir, k, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(docs, k, percent).collect()}
    assert got == want


def test_registered_query(spark, sf_dir):
    out = near_dedup.op3_near_dedup(spark, sf_dir)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_shingles_are_those_of_the_word_rule():
    texts = ["A bé\tc  d\x0ba", "a Bé C d a", "one two", "one two three", "", " \n", "x" * 5000 + " y z", "  \x85  ", "one  TWO"]
    got = shingle_sets([t.encode() for t in texts], 3)
    assert [len(s) for s in got] == [len(set_of(t, 3)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(set_of(a, 3) & set_of(b, 3)), (i, j)


def test_edge_rows(spark):
    base = [f"w{i}" for i in range(100)]
    near = [*base[:50], "changed", *base[51:]]
    rows = [
        (7, " ".join(base), "x"), (3, " ".join(base), "y"), (5, " ".join(near), None), (9, None, "z"), (10, "", "z"), (11, " \t\n", "z"),
        (12, "only two", "z"), (13, "ONLY\ntwo", "z"), (14, " ".join(f"v{i}" for i in range(200_000)), "z"), (14, " ".join(f"v{i}" for i in range(200_000)), "z"), (None, "only two", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicate_groups(docs, 3, 85).collect())
    assert got == [
        (-1, 1, None, False), (3, 98, 3, True), (5, 98, 3, False), (7, 98, 3, False), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True),
        (12, 1, 12, True), (13, 1, 12, False), (14, 199_998, 14, True), (14, 199_998, 14, True),
    ]
    kept = near_dedup.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 10, 11, 12, 14]


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_COPIES", 3)
    rows = [(i, "a b c d e f" if i % 2 else f"own words of {i} here") for i in range(20)] + [(30 + i, "x y z") for i in range(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicate_groups(docs).collect() == []


def test_members_that_no_hub_joins(spark):
    """A family whose members are all a little too far from each other but for a chain of neighbours."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 200])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(docs, 3, 85, m=10).collect()} == want


def test_pairs_of_small_blocks(spark, monkeypatch):
    """Many members that no hub joins, dealt to several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:120] + [f"u{i}_{j}" for j in range(16)])) for i in range(20)]
    rows += [(100 + i, " ".join(words[:120] + [f"v{i}_{j}" for j in range(10)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert 1 < len({c for _, c in want.values()}) < 40
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(docs, 3, 85, m=12).collect()} == want


def test_one_id_with_two_texts_links_them(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "t u v w x y z"), (3, "t u v w x y z"), (4, "else")]
    got = near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_oracle(spark, sf_dir):
    assert_same(near_dedup.op3_near_dedup(spark, sf_dir), near_dedup.ORACLES["op3_near_dedup"], sf_dir)


def test_stage_keeps_documents_without_or_with_clashing_ids(spark):
    """Null ids and ids of several texts lose no text; repeated rows are one, the first in the order of their columns."""
    rows = [(None, "text that no other has at all", 1), (None, "a b c d e f", 1), (2, "a b c d e f", 9), (5, "first text of five here", 1), (5, "second words under five there", 1), (6, "same row here again", 3), (6, "same row here again", 2), (None, None, 1), (None, None, 1), (7, None, 1), (8, "second words under five there", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __node int").repartition(3)
    out = near_dedup.drop_near_duplicates(docs, 3, 85)
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted([(None, "text that no other has at all", 1), (2, "a b c d e f", 9), (5, "first text of five here", 1), (6, "same row here again", 2), (None, None, 1), (7, None, 1), (8, "second words under five there", 4)], key=repr)
    assert near_dedup.drop_near_duplicates(docs.limit(0)).collect() == []


def test_hub_with_several_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB_MEMBERS", 2)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, "other words of one"), (1, " ".join(base))] + [(2 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(9)]
    got = near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 1) for i in range(1, 11)}


@pytest.mark.parametrize("limit", [500_000, 5])
def test_components_of_chains_stars_and_one_giant(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BROADCAST_NODES", limit)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 400)] + [(900, 901), (901, 899)]
    made = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.component for r in components.connected_components(made).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 400)]} | {i: 899 for i in (899, 900, 901)}
    assert got == want
