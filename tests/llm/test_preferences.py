import random

from tarnflow.llm import preferences
from tests.oracle import assert_same


def test_oracle(spark, sf_dir):
    rows = assert_same(preferences.op5_preferences(spark, sf_dir), preferences.ORACLES["op5_preferences"], sf_dir)
    assert rows


def test_edges(spark):
    turns = [
        (1, 0, "system", "s", 9), (1, 1, "user", "q", 9), (1, 2, "assistant", "a1", 9), (1, 3, "user", "q2", 9), (1, 4, "assistant", "a2", 9), (1, 5, "user", "bye", 9),
        (2, 0, "system", "s", 9), (2, 1, "user", "q", 9), (2, 2, "assistant", "b", 9),
        (3, 0, "user", "only", 9), (4, 0, "user", None, 9), (4, 1, "assistant", None, 9), (5, 0, None, "x", 9), (None, 0, "user", "lost", 9),
        (6, 0, "system", "s", 9), (6, 1, "user", "q", 9), (6, 2, "assistant", "b", 9), (7, 0, "user", "long " * 50_000, 9), (7, 1, "assistant", "ok", 9),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pair_id int").repartition(4)
    conversations = preferences.conversation_arrays(table)
    pairs = preferences.stale_answer_pairs(conversations).unionByName(preferences.sibling_pairs(conversations))
    got = {r.pair_id: r for r in preferences.format_preferences(pairs).collect()}
    assert sorted(got) == ["sibling:1:2", "stale:1", "stale:2", "stale:6", "stale:7"]  # 2 and 6 are equal, 4's answers are both empty
    one = got["stale:1"]
    assert one.n_prompt_turns == 4
    assert one.prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\na1<|end|>\n<|user|>\nq2<|end|>\n"
    for completion, mask, answer in ((one.chosen_completion, one.chosen_mask, "a2"), (one.rejected_completion, one.rejected_mask, "a1")):
        a, b = map(int, mask.split(":"))
        assert (one.prompt + completion)[a:b] == f"{answer}<|end|>\n"
    two = got["sibling:1:2"]
    spans = [tuple(map(int, x.split(":"))) for x in two.chosen_mask.split(",")]
    assert [(two.prompt + two.chosen_completion)[a:b] for a, b in spans] == ["a1<|end|>\n", "a2<|end|>\n"]
    assert len(got["stale:7"].prompt) > 250_000


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    conversations = preferences.conversation_arrays(empty)
    assert preferences.format_preferences(preferences.stale_answer_pairs(conversations)).collect() == []


def test_siblings_in_other_blocks(spark):
    ids = {
        "sparse": [5, 1005, 40_000, 7_000_000, 7_000_001, 9_000_000_000], "edge": [998, 999, 1000, 1001, 1999, 2000, 999_999, 1_000_000],
        "signed": [-(2**63), -5_000_000, -1001, -1000, -999, -1, 0, 1, 2**63 - 1], "hashed": [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 + 7 for i in range(1, 60)], "alone": [77_777],
    }
    ids = {k: [x for x in v if not (k != "signed" and x in ids["signed"])] for k, v in ids.items()}
    turns = [(x, n, r, t) for k, v in ids.items() for x in v for n, r, t in ((0, "user", k), (1, "assistant", f"answer {x}"))]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = [r.pair_id for r in preferences.sibling_pairs(preferences.conversation_arrays(table)).collect()]
    want = [f"sibling:{a}:{b}" for v in ids.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False)]
    assert sorted(got) == sorted(want)


def test_branching_conversations_against_the_sql(spark, tmp_path):
    """Different conversations that share from one to many turns, with ids in many blocks."""
    made = random.Random(11)
    turns = []
    for i in range(400):
        tree, at = made.randrange(25), made.randrange(0, 3_000_000)
        conversation = [("system", f"rules {tree}")] * (tree % 2) + [("user", f"question {tree}")]
        while made.random() < 0.8:
            conversation += [("assistant", f"answer {made.randrange(2)} to {len(conversation)}"), ("user", f"more {len(conversation)}")]
        turns += [(at, n, r, t) for n, (r, t) in enumerate(conversation)]
    ids = {}
    turns = [t for t in turns if ids.setdefault((t[0], t[1]), t) is t]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).toPandas().to_parquet(tmp_path / "conversations.parquet")
    rows = assert_same(preferences.op5_preferences(spark, str(tmp_path)), preferences.ORACLES["op5_preferences"], tmp_path)
    siblings = [r.n_prompt_turns for r in preferences.op5_preferences(spark, str(tmp_path)).filter("pair_id LIKE 'sibling%'").collect()]
    assert len(siblings) > 100 and len(set(siblings)) >= 5 and min(siblings) >= 1
    assert len(rows) > len(siblings)


def test_no_siblings(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preferences.sibling_pairs(preferences.conversation_arrays(empty)).collect() == []
    unasked = spark.createDataFrame([(1, 0, "system", "s"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    assert preferences.sibling_pairs(preferences.conversation_arrays(unasked)).collect() == []
